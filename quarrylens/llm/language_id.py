"""Language identification by prediction by partial matching: the language whose byte model codes a text shortest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
#: Code lengths are whole numbers of 2**-20 bits, so that their sums don't depend on an order.
UNIT = 1 << 20
#: Bytes that are looked up at once, and slots of a worker's table of code lengths of byte sequences.
WINDOWS, SLOTS = 1 << 21, 1 << 20
#: More languages than this are an error: a model is held for each.
MOST_LANGUAGES = 10_000


@dataclass
class Settings:
    """order: bytes of the longest context. max_rows and max_bytes bound what a language's model is learned from: a sample by the ids'
    hashes that has so many texts, and then so many bytes, on average; one text at least. max_entries bounds all models
    together: contexts seen too seldom are left out until they fit."""

    order: int = 4
    max_rows: int = 2000
    max_bytes: int = 4 << 20
    max_entries: int = 2_000_000


def grams(joined: bytes, order: int) -> np.ndarray:
    """The order + 1 bytes from each place on, as numbers whose lowest byte is the last one."""
    data = joined + b"\0" * 8
    eight = np.ndarray((max(0, len(joined) - order),), ">u8", buffer=data, strides=(1,))
    return eight.astype("<u8") >> np.uint64(8 * (7 - order))


def padded(texts: list[bytes], order: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts, ASCII capitals lowered, each after as many spaces as a context has bytes, and where the windows of each text begin and
    end: one for each of its bytes."""
    ends = np.cumsum([len(t) + order for t in texts], dtype=np.int64)
    joined = b"".join(b" " * order + t.translate(common.LOWER) for t in texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else ends
    return joined, starts, ends - order


class Tree:
    """One language's context tree with the counts of the bytes that follow each context.

    A context of k bytes and a byte after it are k + 1 bytes; each is written as a number with a 1 before its bytes. A byte is coded in the
    longest context that the tree has. There it takes n / (total + kinds) of the probability if it was seen, and kinds / (total + kinds)
    is for escaping to the context that is one byte shorter, where what was seen in the longer one is excluded. Below no
    context at all, the bytes that were never seen are equally likely. These add up to 1 in every context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, most: int):
        """codes: distinct sequences of order + 1 bytes; counts: how often each was seen; most: entries to keep."""
        self.order = order
        levels = []
        for k in range(order, -1, -1):
            mark = np.uint64(1 << 8 * (k + 1))
            low = codes & (mark - np.uint64(1))
            found, at = np.unique(low, return_inverse=True)
            levels.append((found | mark, np.bincount(at, counts, len(found)).astype(np.int64)))
        entries, n = (np.concatenate([x[i] for x in reversed(levels)]) for i in (0, 1))  # the mark sorts shorter ones first
        nodes, at = np.unique(entries >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, n, len(nodes)).astype(np.int64)
        least, kept = 1, len(entries)
        while kept > most and least <= total.max(initial=0):
            least += 1
            kept = int((total[at] >= least).sum())
        keep = (total[at] >= least) | (entries < 1 << 16)  # bytes without a context stay
        self.entries, self.n = entries[keep], n[keep]
        self.nodes, at = np.unique(self.entries >> np.uint64(8), return_inverse=True)
        self.total = np.bincount(at, self.n, len(self.nodes)).astype(np.int64)
        self.kinds = np.bincount(at, minlength=len(self.nodes)).astype(np.int64)
        # of each context: what is left in the one that is a byte shorter when the bytes seen here are excluded
        size = np.zeros(len(self.entries), np.int64)
        for k in range(1, order + 1):
            size[self.entries >= np.uint64(1 << 8 * (k + 1))] = k
        mark = np.left_shift(np.uint64(1), (8 * size).astype(np.uint64))
        shorter = np.where(size > 0, (self.entries & (mark - np.uint64(1))) | mark, self.entries)
        there = np.searchsorted(self.entries, shorter)
        above = np.searchsorted(self.nodes, self.entries[there] >> np.uint64(8))
        seen = np.bincount(at, self.n[there], len(self.nodes)).astype(np.int64)
        parent = np.zeros(len(self.nodes), np.int64)
        parent[at] = above
        self.left = self.total[parent] - seen
        self.kinds_left = self.kinds[parent] - self.kinds
        self.never = 256 - int(self.kinds[0]) if len(self.nodes) else 256
        if len(self.nodes) and not self.never:  # nothing is left to escape to
            self.kinds_left[(self.nodes >= 1 << 8) & (self.nodes < 1 << 16)] = 0
            self.kinds[0] = 0

    def _find(self, among: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, codes), max(0, len(among) - 1))
        return at, among[at] == codes if len(among) else np.zeros(len(codes), bool)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each sequence after the others."""
        out = np.zeros(len(codes))
        if not len(self.nodes):
            return out + 8.0
        total, kinds = np.zeros(len(codes)), np.zeros(len(codes))
        begun, done = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        for k in range(self.order, -1, -1):
            mark = np.uint64(1 << 8 * (k + 1))
            entry = (codes & (mark - np.uint64(1))) | mark
            node, there = self._find(self.nodes, entry >> np.uint64(8))
            new = there & ~begun
            total[new], kinds[new] = self.total[node[new]], self.kinds[node[new]]
            begun |= there
            live = np.flatnonzero(begun & ~done)
            at, hit = self._find(self.entries, entry[live])
            here = live[hit]
            out[here] += np.log2(total[here] + kinds[here]) - np.log2(self.n[at[hit]])
            done[here] = True
            gone = live[~hit]
            some = gone[kinds[gone] > 0]
            out[some] += np.log2(total[some] + kinds[some]) - np.log2(kinds[some])
            total[gone], kinds[gone] = self.left[node[gone]], self.kinds_left[node[gone]]
        return out + np.where(done, 0.0, np.log2(max(1, self.never)))


class Models:
    """The trees of all languages, in order of their names, and a table of code lengths of byte sequences seen before."""

    def __init__(self, languages: list[str], trees: list[Tree], order: int):
        self.languages, self.trees, self.order = languages, trees, order
        self._keys = None

    def __getstate__(self):
        return {"languages": self.languages, "trees": self.trees, "order": self.order, "_keys": None}

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Of each sequence and language, in UNITs."""
        return np.stack([np.rint(t.bits(codes) * UNIT).astype(np.int32) for t in self.trees], 1) if self.trees else np.zeros((len(codes), 0), np.int32)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (self._size.bit_length() - 1))).astype(np.int64)

    def text_lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each whole text in each language, in UNITs."""
        if self._keys is None:
            self._size = max(1 << 10, min(SLOTS, 1 << (4 * SLOTS // max(1, len(self.trees))).bit_length() - 1))
            self._keys, self._kept = np.full(self._size, ~np.uint64(0)), np.zeros((self._size, len(self.trees)), np.int32)
        joined, starts, ends = padded(texts, self.order)
        out = np.zeros((len(texts), len(self.trees)), np.int64)
        for a in range(0, max(0, len(joined) - self.order), WINDOWS):
            codes = grams(joined[a : a + WINDOWS + self.order], self.order)
            slot = self._slots(codes)
            missed = np.flatnonzero(self._keys[slot] != codes)
            new, back = np.unique(codes[missed], return_inverse=True)
            found = self.lengths(new)
            lo, hi = (np.clip(x - a, 0, len(codes)) for x in (starts, ends))
            for i in range(len(self.trees)):
                each = self._kept[slot, i]
                each[missed] = found[back, i]
                upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                out[:, i] += upto[hi] - upto[lo]
            place, first = np.unique(self._slots(new), return_index=True)
            self._keys[place], self._kept[place] = new[first], found[first]
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def _sample(rows: DataFrame, s: Settings, scratch: common.Scratch) -> DataFrame:
    """(lang, t): the texts that are learned from. A language with more rows or bytes than wanted keeps those whose id's hash is
    under a share of all hashes, and its smallest hash, so no language is gathered or sorted in one task; of rows that repeat an
    id, the smallest text."""
    luck = F.shiftrightunsigned(F.xxhash64("k"), 11) / float(1 << 53)
    known = rows.where(F.col("learn") & F.col("lang").isNotNull() & F.col("k").isNotNull()).withColumn("luck", luck)
    first = scratch.put(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("luck").alias("least")).withColumn("share", s.max_rows / F.col("n")))
    if first.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    under = (F.col("luck") < F.col("share")) | (F.col("luck") == F.col("least"))
    some = known.select("lang", "k", "t", "luck").join(F.broadcast(first.select("lang", "least", "share")), "lang").where(under)  # a row for each language
    taken = scratch.put(some.groupBy("lang", "k", "luck").agg(F.min("t").alias("t"), F.first("share").alias("of_all")))
    sizes = taken.groupBy("lang").agg(F.min("luck").alias("least"), (F.first("of_all") * s.max_bytes / F.greatest(F.lit(1), F.sum(F.octet_length("t")))).alias("share"))
    return taken.join(F.broadcast(sizes), "lang").where(under & F.col("t").isNotNull()).select("lang", "t")


def fit(docs: DataFrame, learn: F.Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """The models of all languages that the rows marked by learn tell of (null marks, ids, texts and languages teach nothing).

    Sequences are counted in the tasks and added up by Spark; distinct ones of a bounded sample come to the driver."""
    s = settings or Settings()
    if not 1 <= s.order <= 6:
        raise ValueError("a context has 1 to 6 bytes")
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"))
    scratch = common.Scratch(docs.sparkSession, "lang")

    def run(batches):
        common.lean()
        for piece in (p for batch in batches for p in common.pieces(batch, "t")):
            langs = common.column(piece, "lang").to_pylist()
            texts = common.encoded(common.column(piece, "t"))
            for lang in sorted(set(langs)):
                joined, starts, ends = padded([t for t, x in zip(texts, langs, strict=True) if x == lang], s.order)
                codes = grams(joined, s.order)
                inside = np.zeros(len(codes) + 1, np.int8)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                found, n = np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    counts = _sample(rows, s, scratch).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = counts["lang"].to_numpy(zero_copy_only=False) if counts.num_rows else np.zeros(0, object)
    codes, n = np.array(counts["code"], np.int64).view(np.uint64), np.array(counts["n"], np.int64)
    names = sorted(set(langs.tolist()), key=lambda x: x.encode())
    scratch.drop(scratch.root)
    return Models(names, [Tree(codes[langs == x], n[langs == x], s.order, s.max_entries // max(1, len(names))) for x in names], s.order)


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and bits_per_byte of each row, in one narrow pass.

    lang_pred is the language whose model codes the whole text (A-Z lowered) with the fewest bits, the first by name of equal ones;
    UNDETERMINED, with a score of 0, where the text is null, has no letter, or no language was learned. score: the share of 2**-bits that
    the language has among all, with bits per byte taken for 32 bytes, or the text's own if they are fewer. bits_per_byte is null
    where nothing was predicted. Models are no larger than their settings allow and are sent to all tasks. Repeated rows are
    repeated, an empty table gives an empty one, other columns are not read, and texts are never cut."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        m = sent.value

        def f(piece: pa.RecordBatch):
            texts = common.decoded(common.column(piece, "t"))
            raw = [t.encode() for t in texts]
            live = np.flatnonzero([bool(m.trees) and has_letter(t) for t in texts])
            pred, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if len(live):
                bits = m.text_lengths([raw[i] for i in live]).astype(np.float64) / UNIT
                size = np.array([len(raw[i]) for i in live], np.float64)
                best = bits.argmin(1)
                least = bits[np.arange(len(live)), best]
                share = 1 / np.exp2(-(bits - least[:, None]) * (np.minimum(size, 32) / size)[:, None]).sum(1)
                for j, i in enumerate(live.tolist()):
                    pred[i], score[i], rate[i] = m.languages[best[j]], share[j], least[j] / size[j]
            return [common.column(piece, "k"), pred, score, rate]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = common.over_batches(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), make, f"k {kind}, lang_pred string, score double, bits_per_byte double", "t")
    return out.withColumnRenamed("k", id_col)


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op12(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
