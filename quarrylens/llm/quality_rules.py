"""Quality rules: base counts of each text, and lines that many documents of one host share."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 8


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, without a loop over words."""
    hashes, offsets, starts, ends = common.word_hashes(texts)
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    points = total((joined & 0xC0) != 0x80)
    chars = total(points[ends] - points[starts])
    symbols = total(_SYMBOL[joined])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offsets))
    windows = common.sequence_hashes(hashes, _WINDOW)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(windows):
        inside = np.flatnonzero(owner[: len(windows)] == owner[_WINDOW - 1 :])
        own = common.mix(windows[inside] ^ common.mix(owner[inside] + np.uint64(1)))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        again = np.zeros(len(own), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        np.add.at(repeated, inside[again], 1)
        np.add.at(repeated, inside[again] + _WINDOW, -1)
    covered = total(np.cumsum(repeated)[:-1] > 0)
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(offsets), "word_chars": np.diff(chars[offsets]), "n_symbols": np.diff(symbols[bounds]),
        "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": np.diff(covered[offsets]),
    }


def _line_key(line: bytes) -> bytes | None:
    line = line.strip().translate(common.LOWER)
    return blake2b(line, digest_size=16).digest() if line else None


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lines(docs: DataFrame, host: F.Column, id_col: str, text_col: str, scratch: common.Scratch) -> DataFrame:
    """k (id), h (host), th (hash of the text), base counts, and the keys of the text's different lines with their words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def f(piece: pa.RecordBatch):
            texts = common.encoded(common.column(piece, "t"))
            base = base_counts(texts)
            hashes, keys, words = [], [], []
            for t in texts:
                hashes.append(blake2b(t, digest_size=16).digest())
                lines: dict[bytes, int] = {}
                for x in t.split(b"\n"):
                    if key := _line_key(x):
                        lines[key] = lines.get(key, 0) + len(x.split())
                keys.append(list(lines))
                words.append(list(lines.values()))
            return [common.column(piece, "k"), common.column(piece, "h"), pa.array(hashes, pa.binary()), *(base[c] for c in _COUNTS), pa.array(keys, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))]

        return f

    src = docs.select(F.col(id_col).alias("k"), host.cast("string").alias("h"), F.col(text_col).alias("t"))
    return scratch.put(common.over_batches(src, make, f"k {kind}, h string, th binary, " + ", ".join(f"{c} long" for c in _COUNTS) + ", keys array<binary>, words array<long>", "t"))


def _frequent(rows: DataFrame, min_docs: int, host_share: float, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Lines by host and text (h, key, th, w words, copies of the text), and those lines of a host (fh, fkey) that n documents hold,
    over its limit; texts tells how many different texts hold one."""
    held = rows.select("h", "th", F.explode(F.arrays_zip("keys", "words")).alias("x")).select("h", "th", F.col("x.keys").alias("key"), F.col("x.words").alias("w"))
    held = scratch.put(held.groupBy("h", "key", "th").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("copies")))
    lines = held.groupBy("h", "key").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts")).where(F.col("n") > min_docs)
    if host_share:
        hosts = rows.groupBy(F.col("h").alias("hh")).agg((host_share * F.count(F.lit(1))).alias("most"))
        lines = lines.join(hosts, lines["h"].eqNullSafe(hosts["hh"])).where(F.col("n") > F.col("most"))
    return held, scratch.put(lines.select(F.col("h").alias("fh"), F.col("key").alias("fkey"), "n", "texts"))


def _same_line(a: DataFrame, b: DataFrame) -> F.Column:
    return (a["key"] == b["fkey"]) & a["h"].eqNullSafe(b["fh"])


def _judge(rows: DataFrame, held: DataFrame, frequent: DataFrame, min_words: int, min_left: int, keep_share: float, max_repeat_percent: int) -> DataFrame:
    total = held.count()
    found = common.joined_by_weight(held, frequent.select("fh", "fkey", F.col("texts").alias("weight")), _same_line, "weight", total)
    gone = found.groupBy(F.col("h").alias("gh"), F.col("th").alias("gth")).agg(F.sum("w").alias("gone"), F.max("copies").alias("copies"))
    same = lambda a, b: (a["th"] == b["gth"]) & a["h"].eqNullSafe(b["gh"])
    given = rows.select("k", "h", "th", *_COUNTS)
    limit = max(common.LEAST_HOT, total // 1000)
    hot, cold = F.broadcast(gone.where(F.col("copies") >= limit)), gone.where(F.col("copies") < limit)
    some = given.where("n_words > 0")
    rest = some.join(hot, same(some, hot), "left_anti")
    columns = ["k", *_COUNTS, F.coalesce("gone", F.lit(0)).alias("gone")]
    out = some.join(hot, same(some, hot)).select(columns).unionByName(rest.join(cold, same(rest, cold), "left").select(columns)).unionByName(given.where("n_words = 0").withColumn("gone", F.lit(0)).select(columns))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("gone")
    return out.select("k", *_COUNTS, failed.alias("base_failed"), left.alias("n_words_left"), (~failed & (left >= min_left) & (left >= keep_share * F.col("n_words"))).alias("kept"))


def verdicts(docs: DataFrame, host: F.Column, min_docs: int = 10, host_share: float = 0.0, min_words: int = 20, min_left: int = 5, keep_share: float = 0.3, max_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row for each row of docs: id, base counts, base_failed, n_words_left, kept; and the frequent lines (host, key, documents).

    base_failed: under min_words words, or over max_repeat_percent of them in repeated 8-word windows. A line (stripped, A-Z
    lower-cased, with a word) is frequent in a host if more than min_docs of its documents, and more than host_share of them, hold it; every
    row is a document, exact copies, too. Frequent lines are removed. A document is depleted, and not kept, if without them it has
    under min_left words or under keep_share of them; of a page with more than min_docs copies in a host none is kept.
    Null and empty texts have no words and fail; null hosts are one host; null ids and repeated rows each give a row; an empty
    table gives empty ones; other columns are not read.

    Lines move as 16-byte keys, counted by text and then by line with partial sums, so neither a hot host nor a hot line meets
    in one task. What returns to a document is a number of words; texts with very many copies get it by broadcast (there
    are a thousand of them at most), and texts without words not at all."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    rows = _lines(docs, host, id_col, text_col, scratch)
    held, frequent = _frequent(rows, min_docs, host_share, scratch)
    return _judge(rows, held, frequent, min_words, min_left, keep_share, max_repeat_percent).withColumnRenamed("k", id_col), frequent.select("fh", "fkey", "n")


def clean(docs: DataFrame, host_col: str, min_docs: int = 10, host_share: float = 0.0, min_words: int = 20, min_left: int = 5, keep_share: float = 0.3, max_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that verdicts() keeps, with all their columns, without the lines that it removes. Ids should be unique: a row
    stays if a row of its id is kept. Texts are hashed once; what a document has to lose comes back to it as a list of keys, one for
    each of its frequent lines at most. Null and empty texts are not kept, and neither are null ids lost: they are one id. An
    empty table gives an empty one. Lines are compared by their bytes; in a text that loses lines, bytes that are not UTF-8
    become U+FFFD."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    rows = _lines(docs, F.col(host_col), id_col, text_col, scratch)
    held, frequent = _frequent(rows, min_docs, host_share, scratch)
    kept_id, gone_id, drop = common.fresh(docs, "kept_id", "gone_id", "drop")
    judged = _judge(rows, held, frequent, min_words, min_left, keep_share, max_repeat_percent)
    kept = judged.where("kept").select(F.col("k").alias(kept_id)).distinct()

    @F.udf("string", useArrow=True)
    def without(text, gone):  # noqa: ANN001
        gone = {bytes(x) for x in gone or []}
        return None if text is None else b"\n".join(x for x in bytes(text).split(b"\n") if _line_key(x) not in gone).decode(errors="replace")

    lines = rows.select(F.col("k").alias(gone_id), "h", F.explode("keys").alias("key"))
    by_line = frequent.select("fh", "fkey", F.col("n").alias("weight"))
    gone = common.joined_by_weight(lines, by_line, _same_line, "weight", lines.count())
    gone = gone.groupBy(gone_id).agg(F.collect_set("key").alias(drop))
    out = docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]), "left_semi")
    out = out.join(gone, out[id_col].eqNullSafe(gone[gone_id]), "left")
    return out.select([(F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(without(F.col(text_col).cast("binary"), F.col(drop))).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    out, _ = verdicts(common.table(spark, sf_dir, "documents"), F.col("source"))
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", "n_words_left")
