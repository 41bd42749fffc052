"""Token counts of a sentencepiece BPE model without tokenising most of the text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces of text that no merge can join: spaces with what follows up to the next space or line end, or a line end.
CHUNKS = regex.compile(r" *[^ \n]+| +|\n")
KEPT_CHUNKS, LONG_CHUNK = 400_000, 48


class Counter:
    """Counts tokens chunk by chunk.

    The vocabulary itself proves that chunks are independent (checked when the model is loaded): no piece has a space
    sign after another sign, and none holds a line end with another sign, so no merge crosses a chunk's edge. A chunk is
    written here with its leading spaces; the model's dummy prefix is one space more before a text that isn't empty."""

    def __init__(self, path: str, whole: frozenset[str]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = whole
        self.kept: dict[str, int] = dict.fromkeys(whole, 1)

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Merges. The model sets a space before each text: it stands for a chunk's first one; a chunk without spaces goes after a line end."""
        given = [c[1:] if c[0] == " " else "\n" + c for c in chunks]
        out = self.model.encode([g or "\n" for g in given], num_threads=1)
        # "\n" alone is the space sign and one byte token: for the chunk " " only the first counts.
        return [len(ids) - (1 if not g else 2 if c[0] != " " else 0) for c, g, ids in zip(chunks, given, out, strict=True)]

    def count_all(self, texts: list[str]) -> list[int]:
        split = []
        for t in texts:
            if not t:
                split.append([])
                continue
            t = " " + t.replace("▁", " ")
            split.append(CHUNKS.findall(t))
        kept, new = self.kept, set()
        for chunks in split:
            new.update(c for c in chunks if c not in kept)
        if len(kept) + len(new) > KEPT_CHUNKS + len(self.whole):
            kept.clear()
            kept.update(dict.fromkeys(self.whole, 1))
            new = {c for chunks in split for c in chunks if c not in kept}
        fresh = list(new)
        if fresh:
            kept.update(zip(fresh, self.count_chunks(fresh), strict=True))
        out = [sum(map(kept.__getitem__, chunks)) for chunks in split]
        for c in fresh:
            if len(c) > LONG_CHUNK:
                del kept[c]
        return out


def prove(path: str) -> frozenset[str]:
    """The vocabulary's strings that the model, given each alone as a chunk, encodes as one token. Raises if the
    vocabulary does not let texts be cut into chunks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    texts = [p.replace("▁", " ") for p in pieces]
    if bad := [t for t in texts if " " in t.lstrip(" ") or ("\n" in t and len(t) > 1)]:
        raise ValueError(f"pieces that cross chunks: {bad[:5]}")
    if "".join(model.encode(" a  b", out_type=str)) != "▁▁a▁▁b":
        raise ValueError("white space is not kept")
    proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    if proto.normalizer_spec.precompiled_charsmap:
        raise ValueError("the model rewrites characters, so chunks are not what is encoded")
    if any(p.type == proto.SentencePiece.USER_DEFINED for p in proto.pieces):
        raise ValueError("the model has user-defined pieces, which are taken before any merge")
    c = Counter(path, frozenset())
    return frozenset(t for t, n in zip(texts, c.count_chunks(texts), strict=True) if n == 1)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row, in one narrow pass.

    The set of proven strings is made once on the driver and sent to the workers: it is no larger than the vocabulary.
    Null and empty texts have 0 tokens; repeated rows are repeated; an empty table gives an empty one; other columns are
    not read; texts are never cut."""
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))

    def make():
        c = common.model(("counter", path), lambda: Counter(path, whole.value))

        def f(piece: pa.RecordBatch):
            texts = common.column(piece, "t")
            n = np.array(c.count_all(common.decoded(texts)), np.int64)
            return [common.column(piece, "k"), pc.fill_null(pc.binary_length(texts), 0), n, n > limit]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = common.over_batches(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), make, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean", "t", ("counter", path))
    return out.withColumnRenamed("k", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
