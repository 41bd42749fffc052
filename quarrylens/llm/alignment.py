"""Alignment of two tokenizers by a dictionary of token groups: links are made once for each different group."""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from . import bpe_codec, common, token_counts

# The characters with Unicode's property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and signs between which a unit may end, unless a piece has them side by side.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A worker keeps the groups of at most so many units; longer units are forgotten with their block. Texts of a block, in bytes and number.
KEPT_UNITS, LONG_UNIT = 500_000, 48
BLOCK_BYTES, BLOCK_TEXTS = 6 << 20, 20_000


class Aligner:
    """Encodes units of text by both tokenizers and cuts them where tokens of both end.

    Units are taken apart on their own by both: they begin at a space or line end after a character that isn't white space, or at
    a sign after a letter. There the byte-level vocabulary begins a word, and no piece of the other goes on: for spaces
    and line ends, token_counts.prove() shows it, and signs that a piece has after a letter are not among those here."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        letters = bpe_codec._byte_letters()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = t.encode() if t in special else bytes(map(letters.__getitem__, t))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.line_end = self.b.encode("\n")
        after = re.compile(f"(?<=[{LETTERS}]).")
        joined = {c for i, p in enumerate(pieces) if not self.b.is_byte(i) for c in after.findall(p)}
        signs = "".join(re.escape(c) for c in SIGNS if c not in joined)
        word = f"[^{WHITE}](?:[^{WHITE}{signs}]+|(?<![{LETTERS}])[{signs}]+)*" if signs else f"[^{WHITE}]+"
        self.units = re.compile(f"[{WHITE}]*{word}(?:(?![ \n])[{WHITE}]+(?:{word}|\\Z))*|[{WHITE}]+")
        self.forget()

    def forget(self) -> None:
        #: unit -> whole numbers: how many tokens of A and of B it has (-1 where B has other bytes than the unit), and its groups
        self.known: dict[str, bytes] = {}
        #: the groups' numbers, and their texts ("a1,a2|b1")
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []

    def _a_ids(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """The model sets a space before what it is given: it stands for a unit's own first one; others are given after a line end."""
        given = [("\n" if u == " " else u[1:]) if u[0] == " " else "\n" + u for u in units]
        return [ids[:1] if u == " " else ids if u[0] == " " else ids[len(self.line_end) :] for u, ids in zip(units, self.b.encode(given, num_threads=1), strict=True)]

    def groups_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of different units: tokens of A and of B, number of groups, and all groups one after the other."""
        known = self.known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > KEPT_UNITS:
            self.forget()
            known, new = self.known, units
        if new:
            known.update(zip(new, self._cut(new), strict=True))
        found = [known[u] for u in units]
        for u in new:
            if len(u) > LONG_UNIT:
                del known[u]
        flat = np.frombuffer(b"".join(found), "<i4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        head = np.cumsum(sizes) - sizes
        rest = np.ones(len(flat), bool)
        rest[head] = rest[head + 1] = False
        return flat[head].astype(np.int64), flat[head + 1].astype(np.int64), sizes - 2, flat[rest].astype(np.int64)

    def _cut(self, units: list[str]) -> list[bytes]:
        """All units at once, as if they were one text: bytes of both sides are compared by units, then ends over all."""
        raw = [u.encode() for u in units]
        a, b = self._a_ids(units), self._b_ids(units)
        same = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == w == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, w in zip(a, b, raw, strict=True)], bool)
        n_a, n_b = (np.where(same, np.fromiter(map(len, x), np.int64, len(units)), k) for x, k in ((a, 0), (b, -1)))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(compress(x, same)), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = (np.searchsorted(e, cuts, "right") for e in (ends_a, ends_b))
        groups = self._numbered(flat_a, to_a, flat_b, to_b)
        upto = np.searchsorted(to_a, np.cumsum(n_a), "right")  # groups up to each unit's end
        n = np.diff(upto, prepend=0)
        ends = np.cumsum(n + 2)
        out = np.empty(int(ends[-1]), "<i4")
        head = ends - n - 2
        rest = np.ones(len(out), bool)
        rest[head] = rest[head + 1] = False
        out[head], out[head + 1], out[rest] = n_a, n_b, groups
        data = out.tobytes()
        return [data[i:j] for i, j in zip((4 * head).tolist(), (4 * ends).tolist(), strict=True)]

    def _numbered(self, flat_a: np.ndarray, to_a: np.ndarray, flat_b: np.ndarray, to_b: np.ndarray) -> np.ndarray:
        """The number of each group. Groups of one token of A and of B are written once for each different pair."""
        from_a, from_b = (np.concatenate([[0], t[:-1]]).astype(np.int64) if len(t) else t for t in (to_a, to_b))
        single = (to_a - from_a == 1) & (to_b - from_b == 1)
        out = np.empty(len(to_a), np.int64)
        codes, back = np.unique(flat_a[from_a[single]] << 32 | flat_b[from_b[single]], return_inverse=True)
        out[single] = np.array([self._number(f"{c >> 32}|{c & 0xFFFFFFFF}") for c in codes.tolist()], np.int64)[back]
        la, lb = flat_a.tolist(), flat_b.tolist()
        others = np.flatnonzero(~single)
        out[others] = [self._number(",".join(map(str, la[i:j])) + "|" + ",".join(map(str, lb[k:m]))) for i, j, k, m in zip(*(x[others].tolist() for x in (from_a, to_a, from_b, to_b)), strict=True)]
        return out

    def _number(self, group: str) -> int:
        found = self.numbers.setdefault(group, len(self.texts))
        if found == len(self.texts):
            self.texts.append(group)
        return found

    def links(self, group: str) -> list[tuple[int, int, int]]:
        """(a, b, n) of a group: its tokens whose byte ranges overlap, and how often these two ids do."""
        a, b = (list(map(int, side.split(","))) for side in group.split("|"))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first = np.searchsorted(ends_b, ends_a - self.a_size[a], "right")
        last = np.searchsorted(ends_b, ends_a, "left")
        n = last - first + 1
        left = np.repeat(np.array(a, np.int64), n)
        right = np.array(b, np.int64)[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        codes, count = np.unique(left << 32 | right, return_counts=True)
        return list(zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist(), count.tolist(), strict=True))


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of these files."""
    return common.model(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of texts: their ids, counts and digests; which groups each text has and how often; and the different
    groups of the block, with how often they are in it and in how many of its texts."""
    id_type = to_arrow_type(docs.schema["k"].dataType)

    def flush(ids, texts, number):
        c = aligner(a_path, b_path)
        units: dict[str, int] = {}
        split = []
        for t in texts:
            found = c.units.findall(" " + t) if t else []
            split.append(np.fromiter((units.setdefault(u, len(units)) for u in found), np.int32, len(found)))
        n_a, n_b, sizes, flat = c.groups_of(list(units))
        begin = np.cumsum(sizes) - sizes
        own, flat = np.unique(flat, return_inverse=True)  # the block's groups
        names = [c.texts[g] for g in own.tolist()]
        facts, digests, at, times, ends = np.zeros((len(texts), 3), np.int64), [], [], [], np.zeros(len(texts), np.int64)
        freq, held = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for i, mine in enumerate(split):
            if not len(mine) or (n_b[mine] < 0).any():
                digests.append("")
                continue
            n = sizes[mine]
            groups = flat[np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            digests.append(hashlib.sha256(";".join(map(names.__getitem__, groups.tolist())).encode()).hexdigest())
            seen, count = np.unique(groups, return_counts=True)
            facts[i] = n_a[mine].sum(), n_b[mine].sum(), len(groups)
            freq[seen] += count
            held[seen] += 1
            at.append(seen)
            times.append(count)
            ends[i] = len(seen)
        keep = np.flatnonzero(freq)  # groups that only texts without tokens have are none
        place = np.cumsum(freq > 0) - 1
        at, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, times))
        row = [number, ids, facts.astype("<i8").tobytes(), digests, common.packed(np.cumsum(ends).astype("<i8")), common.packed(place[at].astype("<i4")), common.packed(times.astype("<i4")), [names[j] for j in keep.tolist()], freq[keep].tolist(), held[keep].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], schema)

    schema = ["block", "ids", "facts", "digests", "ends", "at", "times", "groups", "n", "documents"]
    types = [pa.int64(), pa.list_(id_type), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for piece in (p for batch in batches for p in common.pieces(batch, "t")):
            found = common.decoded(common.column(piece, "t"))
            ids += common.column(piece, "k").to_pylist()
            texts += found
            size += sum(map(len, found))
            if size >= BLOCK_BYTES or len(texts) >= BLOCK_TEXTS:
                yield flush(ids, texts, number)
                number += 1
                ids, texts, size = [], [], 0
        if texts:
            yield flush(ids, texts, number)

    return docs.mapInArrow(run, f"block long, ids array<{docs.schema['k'].dataType.simpleString()}>, facts binary, digests array<string>, ends binary, at binary, times binary, groups array<string>, n array<long>, documents array<long>")


def _dictionary(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, scratch: common.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of texts; (g, group, n, documents) of every different group of the corpus; and (g, a, b, m, n, documents): its links."""
    token_counts.prove(b_path)  # no piece goes over a unit's edge
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    blocks = scratch.put(_blocks(rows, a_path, b_path))
    each = blocks.select(F.explode(F.arrays_zip("groups", "n", "documents")).alias("g")).select(F.col("g.groups").alias("group"), "g.n", "g.documents")
    groups = each.groupBy("group").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    groups = scratch.put(groups.withColumn("g", F.monotonically_increasing_id()))

    def run(batches):
        c = aligner(a_path, b_path)
        for batch in batches:
            found = [c.links(g) for g in common.column(batch, "group").to_pylist()]
            flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3)
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([common.column(batch, "g").take(row), pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2]), common.column(batch, "n").take(row), common.column(batch, "documents").take(row)], ["g", "a", "b", "m", "n", "documents"])

    return blocks, groups, scratch.put(groups.mapInArrow(run, "g long, a int, b int, m long, n long, documents long"))


def _pairs(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("n")).alias("links"), F.sum(F.col("m") * F.col("documents")).alias("document_links"), F.count(F.lit(1)).alias("groups"))


def pair_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, links, document_links and groups: of two ids, how many links of the corpus hold them, how many if each text counts a
    group once, and how many different groups they are linked in. Texts are treated as align() does."""
    return _pairs(_dictionary(docs, a_path, b_path, id_col, text_col, common.Scratch(docs.sparkSession, "pairs"))[2])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    A space and the text are encoded by a byte-level BPE file (A), the text by a sentencepiece model (B) that sets the space itself.
    Offsets where tokens of both end cut them to groups; tokens of a group whose byte ranges overlap are linked. An id
    pair's count is the number of links that hold it in the whole corpus. n_best: links whose count is the highest of their B
    id, ties included. count_sum: the counts of a row's links, added up. groups_sha256: of all groups in order.

    Null and empty texts have no tokens, nor have texts whose tokens' bytes are others than the space and the text (a text with
    U+2581 is one): zeros and an empty digest. Bytes that are not UTF-8 are read as U+FFFD. Repeated rows count and are returned
    each, an empty table gives an empty one, other columns are not read, and texts are never cut.

    Blocks of texts keep their own different groups; these are interned over the corpus, and links are made once for each
    different group and multiplied by how often it occurs. A group is one row from each block however often it occurs, and the
    sums of its links come back to each block by the group. Only the highest counts, a row for each B id, are broadcast."""
    scratch = common.Scratch(docs.sparkSession, "alignment")
    blocks, groups, links = _dictionary(docs, a_path, b_path, id_col, text_col, scratch)
    pairs = scratch.put(_pairs(links))
    highest = pairs.groupBy("b").agg(F.max("links").alias("highest"))  # as many as B has ids at most
    counts = pairs.join(F.broadcast(highest), "b").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("links").alias("count"), (F.col("links") == F.col("highest")).alias("best"), "groups")
    total = links.agg(F.count(F.lit(1))).first()[0]
    rated = common.joined_by_weight(links, counts, lambda x, y: (x["a"] == y["pa"]) & (x["b"] == y["pb"]), "groups", total)
    sums = rated.groupBy("g").agg(F.sum("m").alias("n_links"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum"))
    sums = groups.select("g", "group").join(sums, "g").drop("g")
    asked = blocks.select("block", F.posexplode("groups").alias("pos", "group"))
    told = asked.join(sums, "group").groupBy("block").agg(F.collect_list(F.struct("pos", "n_links", "n_best", "count_sum")).alias("told"))  # a block's groups are bounded
    kind = docs.schema[id_col].dataType

    def run(batches):
        common.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                get = lambda c: common.column(one, c)[0].as_py()  # noqa: E731, B023
                facts = np.frombuffer(get("facts"), "<i8").reshape(-1, 3)
                ends, at, times = common.unpacked(get("ends"), "<i8"), common.unpacked(get("at"), "<i4"), common.unpacked(get("times"), "<i4").astype(np.int64)
                told = common.column(one, "told").flatten()
                values = np.zeros((len(told), 3), np.int64)
                if len(told):
                    values[np.array(told.field("pos"))] = np.stack([np.array(told.field(c)) for c in ("n_links", "n_best", "count_sum")], 1)
                upto = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(values[at] * times[:, None], axis=0)])
                each = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
                yield pa.RecordBatch.from_arrays([common.column(one, "ids").flatten(), *(pa.array(np.ascontiguousarray(x)) for x in (*facts.T, *each.T)), common.column(one, "digests").flatten()], ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = blocks.select("block", "ids", "facts", "digests", "ends", "at", "times").join(told, "block", "left").drop("block")
    return out.mapInArrow(run, f"k {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").withColumnRenamed("k", id_col)


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
