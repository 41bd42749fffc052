"""N-gram scores from a log-frequency Bloom filter."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The token that ends each text, and that stands before its first word. A word can't hold a space.
END = b" "
#: Texts are packed to blocks of about so many bytes; a block has one list of its distinct words.
BLOCK_BYTES = 5 << 20
#: Text bytes for each shard of the counts.
SHARD_BYTES = 16 << 20
#: A word that is so large a share of the training tokens (and so many) is frequent: its bigrams are dealt by both words, all
#: others by the first, so that a shard holds the sums of its words. There are a thousand of them at most.
FREQUENT_SHARE, LEAST_FREQUENT = 1000, 1000
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix(before * _A + common.mix(word + _B))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _runs(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted numbers, their added counts, and each one's place in that order."""
    order = np.argsort(first, kind="stable")
    at = np.flatnonzero(np.diff(first[order], prepend=~first[order][:1]))
    return first[order][at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], order[at]


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count)), in 1 to 255."""
    return np.minimum(255, 1 + np.floor(np.log(counts) / np.log(base) + 1e-9)).astype(np.int64)


def dequantised(levels: np.ndarray, base: float) -> np.ndarray:
    """The middle of the counts that share a level, 0 for level 0; level 1 is a count of 1 if base**1 <= 2."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.ceil(base**levels - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def _places(keys: np.ndarray, j: int, i: int, size) -> np.ndarray:
    """The ith bit of (key, j) in a segment of size bits (fewer than 2**32)."""
    h = common.mix(keys.astype(np.uint64) + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))
    return ((((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def segment(keys: np.ndarray, levels: np.ndarray, bits_per_entry: float, hashes: int) -> np.ndarray:
    """The Bloom filter of one shard, as bytes: it holds (key, j) for every level j up to the key's own."""
    bits = np.zeros(max(8, int(levels.sum() * bits_per_entry / 8) + 1), np.uint8)
    for j in range(1, int(levels.max(initial=0)) + 1):
        held = keys[levels >= j]
        for i in range(hashes):
            at = _places(held, j, i, np.uint64(len(bits) * 8))
            np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return bits


@dataclass
class Filter:
    """Segments side by side; starts and sizes (in bytes) by shard, size 0 for shards that aren't in it."""

    bits: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: int

    def levels(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Probes level after level until a key is missing."""
        out = np.zeros(len(keys), np.uint8)
        live = np.flatnonzero(self.sizes[shards] > 0)
        for j in range(1, 256):
            for i in range(self.hashes):
                s = shards[live]
                at = _places(keys[live], j, i, self.sizes[s].astype(np.uint64) * np.uint64(8))
                live = live[(self.bits[self.starts[s] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
            if not len(live):
                break
            out[live] = j
        return out


@dataclass
class Settings:
    base: float = 1.5
    bits_per_entry: float = 9.0
    hashes: int = 5
    prior: float = 300.0
    max_filter_mb: int = 256


def _pack(docs: DataFrame, shards: int, kind: str) -> DataFrame:
    """Blocks of tokenised texts (part "doc"), and their words by shard with training counts ("word")."""

    def flush(ids, train, texts):
        vocab: dict[bytes, int] = {END: 0}
        tokens, ends = [], []
        for t in texts:
            words = t.translate(common.LOWER).split()
            for w in set(words).difference(vocab):
                vocab[w] = len(vocab)
            tokens.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
            tokens.append(np.zeros(1, np.int32))
            ends.append(len(words) + 1)
        flat, ends, learn = np.concatenate(tokens), np.cumsum(ends), np.array(train, bool)
        counts = np.bincount(flat[np.repeat(learn, np.diff(ends, prepend=0))], minlength=len(vocab))
        words = list(vocab)
        h = _word_keys(words)
        block = uuid.uuid4().int >> 65  # any number will do: what a task wrote stays as it is
        out = [("doc", block, -1, common.packed(flat.astype("<i4")), common.packed(ends.astype("<i8")), common.packed(h.astype("<u8")), np.packbits(learn).tobytes(), ids)]
        ws = _shard_of(h, shards)
        order = np.argsort(ws, kind="stable")
        cuts = np.searchsorted(ws[order], np.arange(shards + 1))
        for s in range(shards):
            mine = order[cuts[s] : cuts[s + 1]]
            if len(mine):
                out.append(("word", block, s, zstandard.compress(b"\n".join([words[i] for i in mine.tolist()]), 1), common.packed(mine.astype("<i4")), common.packed(counts[mine].astype("<i8")), b"", []))
        for part, block, s, a, b, c, d, e in out:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.int64()), pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in (a, b, c, d)), pa.array([e], pa.list_(id_type))], ["part", "block", "shard", "a", "b", "c", "d", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["k"].dataType)

    def run(batches):
        common.lean()
        ids, train, texts, size = [], [], [], 0
        for piece in (piece for batch in batches for piece in common.pieces(batch, "t")):
            for i, r, t in zip(common.column(piece, "k").to_pylist(), common.column(piece, "learn").to_pylist(), common.encoded(common.column(piece, "t")), strict=True):
                ids.append(i)
                train.append(bool(r))
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES or len(texts) >= 50_000:
                    yield from flush(ids, train, texts)
                    ids, train, texts, size = [], [], [], 0
        if texts:
            yield from flush(ids, train, texts)

    return docs.mapInArrow(run, f"part string, block long, shard int, a binary, b binary, c binary, d binary, ids array<{kind}>")


def _word_keys(words: list[bytes]) -> np.ndarray:
    """A hash of each word; the end has its own."""
    h = common.word_hashes([w for w in words if w != END])[0]
    out = np.full(len(words), np.uint64(0x1234567), np.uint64)
    out[[i for i, w in enumerate(words) if w != END]] = h
    return out


def _pairs(blocks: DataFrame, shards: int, frequent: np.ndarray) -> DataFrame:
    """Each block's distinct training bigrams with their counts, by shard: those of a first word stand together, its hash and
    their number given once; those of frequent first words (sorted hashes) by that word's place."""

    def run(batches):
        common.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: common.column(batch, name)[i].as_py()  # noqa: E731, B023
                flat, ends, h = common.unpacked(get("a"), "<i4").astype(np.int64), common.unpacked(get("b"), "<i8"), common.unpacked(get("c"), "<u8")
                learn = np.unpackbits(np.frombuffer(get("d"), np.uint8), count=len(ends)).astype(bool)
                before = np.concatenate([np.zeros(1, np.int64), flat[:-1]])
                ids = np.sort((before * len(h) + flat)[np.repeat(learn, np.diff(ends, prepend=0))])
                first = np.flatnonzero(np.diff(ids, prepend=-1))
                n = np.minimum(np.diff(np.append(first, len(ids))), 2**32 - 1)
                v, w = np.divmod(ids[first], len(h))
                route, keys = h[v], _pair_keys(h[v], h[w])
                low = keys & np.uint64(0xFFFFFFFF)
                hot = np.isin(h, frequent)[v]
                shard = _shard_of(np.where(hot, keys, route), shards)
                order = np.lexsort((low, route, hot, shard))
                route, low, n, hot, shard = (x[order] for x in (route, low, n, hot, shard))
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                for s in range(shards):
                    a, b = cuts[s], cuts[s + 1]
                    if b > a:
                        mid = a + int((~hot[a:b]).sum())
                        start = np.flatnonzero(np.diff(route[a:mid], prepend=~route[a] if mid > a else np.uint64(0)))
                        rows = [s, common.packed(np.diff(route[a:mid][start], prepend=np.uint64(0))), common.packed(np.diff(np.append(start, mid - a)).astype("<u4"))]
                        rows += [common.packed(low[a:b].astype("<u4")), common.packed(n[a:b].astype("<u4")), common.packed(np.searchsorted(frequent, route[mid:b]).astype("<u2"))]
                        yield pa.RecordBatch.from_arrays([pa.array([rows[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in rows[1:])], ["shard", "firsts", "runs", "keys", "counts", "hot"])

    return blocks.mapInArrow(run, "shard int, firsts binary, runs binary, keys binary, counts binary, hot binary")


def _distinct_pairs(flat: np.ndarray, h: np.ndarray, frequent: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct bigrams: their numbers, places of the first and second word, key in a segment, and shard."""
    before = np.concatenate([np.zeros(1, np.int64), flat[:-1]])
    ids = np.unique(before * len(h) + flat)
    v, w = np.divmod(ids, len(h))
    keys = _pair_keys(h[v], h[w])
    shard = _shard_of(np.where(np.isin(h, frequent)[v], keys, h[v]), shards).astype(np.int64)
    return ids, v, w, keys & np.uint64(0xFFFFFFFF), shard


def _asked(blocks: DataFrame, shards: int, frequent: np.ndarray) -> DataFrame:
    """Each block's distinct bigrams by shard: their places in the block's order, and keys."""

    def run(batches):
        common.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: common.column(batch, name)[i].as_py()  # noqa: E731, B023
                _, _, _, keys, shard = _distinct_pairs(common.unpacked(get("a"), "<i4").astype(np.int64), common.unpacked(get("c"), "<u8"), frequent, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[s] : cuts[s + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([get("block")], pa.int64()), pa.array([s], pa.int32()), pa.array([common.packed(mine.astype("<i4"))], pa.binary()), pa.array([common.packed(keys[mine].astype("<u4"))], pa.binary())], ["block", "shard", "at", "keys"])

    return blocks.mapInArrow(run, "block long, shard int, at binary, keys binary")


def score(docs: DataFrame, learn: F.Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score for each row; the model learns from the rows that learn marks.

    Tokens: A-Z lower-cased words between ASCII white space, and one end. base_score: exact unigram log10 probability with
    half a count added. score: log10 probability of the text under the bigram model
    p(w | v) = (d(v w) + prior * p(w)) / (d(v) + prior), where d(v w) is the quantised count's middle, d(v) the sum of these over
    all w, exact, and p(w) the exact unigram. So p(. | v) adds up to 1 over the known words and one unknown; d(v w) comes from a
    Bloom filter by repeated probes, and where a probe finds a level too high (some in a hundred), so is d(v w).

    Texts are packed once into blocks of tokens. Unigrams: each block sends its distinct words, parted by hash, and gets
    their counts over the whole corpus back, so no list of all words is anywhere. Bigrams: each block sends its distinct ones to
    the shard of their first word (of both words, if the first is frequent), which makes its segment of the filter and tells the
    blocks the sums of their words; the frequent words' sums, a thousand at most, are added over shards. A filter of max_filter_mb at most
    is broadcast and probed where the texts are; of a larger one, each segment is probed in a task of its own by the
    distinct bigrams that the blocks send to it, with the same levels. So the broadcast is bounded and no text is read
    more often at any size. Null text is empty: an end alone. Null learn marks count as false. Repeated rows count and are returned
    each. An empty table gives an empty one. Without training rows every count is 0. Other columns are not read."""
    s = settings or Settings()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(8, min(1 << 20, -(-size // SHARD_BYTES)))
    scratch = common.Scratch(spark, "lm")
    shards = int(shards)
    packed, path = scratch.parted(_pack(rows, shards, kind), "part")

    def unigrams(key, table):
        common.lean()
        totals: dict[bytes, int] = {}
        parts = []
        for block, words, at, counts in zip(table["block"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist(), table["c"].to_pylist(), strict=True):
            words = zstandard.decompress(words).split(b"\n")
            parts.append((block, words, at))
            for w, n in zip(words, common.unpacked(counts, "<i8").tolist(), strict=True):
                if n:
                    totals[w] = totals.get(w, 0) + n
        got = [common.packed(np.fromiter((totals.get(w, 0) for w in words), "<i8", len(words))) for _, words, _ in parts]
        n, total = len(parts), sum(totals.values())
        often = [w for w, c in totals.items() if c >= max(LEAST_FREQUENT, total // FREQUENT_SHARE)]  # no frequent word is missing
        often = [{"h": x, "c": totals[w]} for w, x in zip(often, _word_keys(often).view(np.int64).tolist(), strict=True)]
        return pa.table({
            "block": pa.array([p[0] for p in parts], pa.int64()), "at": pa.array([p[2] for p in parts], pa.binary()), "n": pa.array(got, pa.binary()),
            "total": pa.array([total] + [0] * (n - 1), pa.int64()), "distinct": pa.array([len(totals)] + [0] * (n - 1), pa.int64()),
            "often": pa.array([often] + [[]] * (n - 1), pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))),
        })

    words = packed.where("part = 'word'").select("shard", "block", "a", "b", "c")
    known = scratch.put(words.groupBy("shard").applyInArrow(unigrams, "block long, at binary, n binary, total long, distinct long, often array<struct<h:long,c:long>>"))
    total, distinct = known.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = int(total or 0), int(distinct or 0)
    often = known.select(F.explode("often").alias("x")).where(F.col("x.c") >= max(LEAST_FREQUENT, total // FREQUENT_SHARE)).select("x.h").collect()
    frequent = np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64))

    def segments(key, pairs, words):
        """A shard's segment, the sums of its part of the frequent words, and each block's sums of the words that it asks for."""
        common.lean()
        get = lambda c, kind: [common.unpacked(x, kind) for x in pairs[c].to_pylist()]
        ctx = [np.cumsum(x, dtype=np.uint64) for x in get("firsts", "<u8")]
        runs, hots, keys, counts = get("runs", "<u4"), get("hot", "<u2"), get("keys", "<u4"), get("counts", "<u4")
        names = np.unique(np.concatenate([*ctx, np.zeros(0, np.uint64)]))
        # a number for each bigram: its first word's place (frequent ones after the others), and its key
        who = [np.concatenate([np.repeat(np.searchsorted(names, c), r), len(names) + x.astype(np.int64)]) for c, r, x in zip(ctx, runs, hots, strict=True)]
        pair = np.concatenate([*((w.astype(np.uint64) << np.uint64(32)) | k for w, k in zip(who, keys, strict=True)), np.zeros(0, np.uint64)])
        pair, n, _ = _runs(pair, np.concatenate([*counts, np.zeros(0, np.uint32)]).astype(np.int64))
        level = quantised(n, s.base)
        twice = (2 * dequantised(level.astype(float), s.base)).astype(np.int64)
        sums = np.bincount((pair >> np.uint64(32)).astype(np.int64), twice, len(names) + len(frequent)).astype(np.int64)
        bits = segment(pair & np.uint64(0xFFFFFFFF), level, s.bits_per_entry, s.hashes)
        out = [(None, None, None, key[0].as_py(), bits.tobytes(), len(bits), sums[len(names) :].tolist())]
        for block, asked, at in zip(words["block"].to_pylist(), words["a"].to_pylist(), words["b"].to_pylist(), strict=True):
            h = _word_keys(zstandard.decompress(asked).split(b"\n"))
            place = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
            out.append((block, at, common.packed(np.where(names[place] == h, sums[place], 0).astype("<i8") if len(names) else np.zeros(len(h), "<i8")), None, None, None, None))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["block", "at", "n", "shard", "bits", "size", "sums"])

    pairs = _pairs(packed.where("part = 'doc'").select("a", "b", "c", "d"), shards, frequent)
    made, made_path = scratch.parted(pairs.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(segments, "block long, at binary, n binary, shard int, bits binary, size long, sums array<long>").withColumn("kind", F.when(F.col("block").isNull(), "segment").otherwise("sum")), "kind")
    scratch.drop(f"{path}/part=word")
    sums = made.where("kind = 'sum'").select("block", "at", "n")
    made = made.where("kind = 'segment'")
    hot_sums = np.zeros(len(frequent), np.int64)
    for r in made.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # a thousand at most
        hot_sums[r["i"]] = r["x"]
    sizes = np.zeros(shards, np.int64)
    for r in made.select("shard", "size").toLocalIterator():
        sizes[r["shard"]] = r["size"]
    joined = int(sizes.sum()) > s.max_filter_mb << 20

    def whole_filter() -> Filter:
        starts = np.cumsum(sizes) - sizes
        bits = np.zeros(int(sizes.sum()), np.uint8)
        for r in made.select("shard", "size", "bits").toLocalIterator():
            bits[starts[r["shard"]] : starts[r["shard"]] + r["size"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return Filter(bits, starts, sizes, s.hashes)

    def answers(key, probes, own):
        common.lean()
        found = [np.frombuffer(x, np.uint8) for x in own["bits"].to_pylist()]
        got = []
        for keys in probes["keys"].to_pylist():
            keys = common.unpacked(keys, "<u4")
            none = np.zeros(len(keys), np.uint8)
            got.append(common.packed(Filter(found[0], np.zeros(1, np.int64), np.array([len(found[0])]), s.hashes).levels(keys, np.zeros(len(keys), np.int64)) if found else none))
        return pa.table([probes["block"], probes["at"], pa.array(got, pa.binary())], ["block", "at", "n"])

    told = known.select("block", "at", "n", F.lit("count").alias("of")).unionByName(sums.withColumn("of", F.lit("sum")))
    if joined:
        asked = _asked(packed.where("part = 'doc'").select("block", "a", "c"), shards, frequent).groupBy("shard")
        told = told.unionByName(asked.cogroup(made.select("shard", "bits").groupBy("shard")).applyInArrow(answers, "block long, at binary, n binary").withColumn("of", F.lit("level")))
    counts_of = told.groupBy("block").agg(F.collect_list(F.struct("at", "n", "of")).alias("known"))
    blocks = packed.where("part = 'doc'").select("block", "a", "b", "c", "ids").join(counts_of, "block")
    names = ["block", "pos", "k", "n_tokens", "n_known", "base_score", "score"]

    def scorer(sent):
        def texts(row):
            common.lean()
            get = lambda name: common.column(row, name)[0].as_py()
            flat, ends, h = common.unpacked(get("a"), "<i4"), common.unpacked(get("b"), "<i8"), common.unpacked(get("c"), "<u8")
            c, twice = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            every, levels = None, None
            if joined:
                every = _distinct_pairs(flat.astype(np.int64), h, frequent, shards)[0]
                levels = np.zeros(len(every), np.uint8)
            for x in get("known"):
                to = {"count": c, "sum": twice, "level": levels}[x["of"]]
                to[common.unpacked(x["at"], "<i4")] = common.unpacked(x["n"], "<i8" if x["of"] != "level" else "u1")
            hot = np.isin(h, frequent)
            twice[hot] = hot_sums[np.searchsorted(frequent, h[hot])]
            below = twice / 2 + s.prior
            p = (c + 0.5) / (total + 0.5 * (distinct + 1))
            log_p = np.log10(p)
            starts = np.concatenate([[0], ends[:-1]])
            base, score = np.zeros(len(ends)), np.zeros(len(ends))
            a = 0
            while a < len(ends):  # about half a million tokens at a time, one text at least
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + 500_000)))
                here = flat[starts[a] : ends[b - 1]]
                before = np.concatenate([np.zeros(1, here.dtype), here[:-1]])
                ids, back = np.unique(before.astype(np.int64) * len(h) + here, return_inverse=True)
                v, w = np.divmod(ids, len(h))
                if joined:
                    level = levels[np.searchsorted(every, ids)]
                else:
                    keys = _pair_keys(h[v], h[w])
                    level = sent.value.levels(keys & np.uint64(0xFFFFFFFF), _shard_of(np.where(hot[v], keys, h[v]), shards).astype(np.int64))
                level = np.where((c[v] > 0) & (c[w] > 0), level, 0)
                q = np.log10((dequantised(level.astype(float), s.base) + s.prior * p[w]) / below[v])[back]
                cuts = starts[a:b] - starts[a]
                score[a:b], base[a:b] = np.add.reduceat(q, cuts), np.add.reduceat(log_p[here], cuts)
                a = b
            n_known = np.add.reduceat((c > 0)[flat].astype(np.int64), starts)
            ids = common.column(row, "ids").flatten()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), get("block"))), pa.array(np.arange(len(ends))), ids, pa.array(ends - starts), pa.array(n_known), pa.array(base), pa.array(score)], names)

        return lambda batches: (texts(batch.slice(i, 1)) for batch in batches for i in range(batch.num_rows))

    sent = None if joined else spark.sparkContext.broadcast(whole_filter())
    out = blocks.mapInArrow(scorer(sent), f"block long, pos long, k {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("k").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
