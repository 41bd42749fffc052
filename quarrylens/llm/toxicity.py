"""Toxicity by nearest labelled examples: exact TF-IDF cosine of all terms over a block-max inverted index."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: ASCII signs and digits part words, like white space does; capitals become small.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: Beside a word itself, its first so many bytes are terms: they tie a stem's endings together.
PREFIXES = (4, 5)
#: A term that this share of the examples holds is frequent: it is a row of each block's matrix, with a maximum for each block.
DENSE_SHARE = 0.05
#: Examples of a block; texts that meet the blocks together; blocks of highest bound that each text meets first.
BLOCK, TOGETHER, FIRST = 64, 320, 4
#: Directions in which examples differ most, told from so many examples: two vectors' product is at most that of their parts along
#: these and that of the lengths of what is left. Any directions give the same neighbours.
DIRECTIONS, FITTED = 32, 1000
#: Texts are taken in pieces of about so many bytes, and their terms are counted in smaller ones: words' arrays take some thirty
#: times the room.
TERMS_OF_BYTES, COUNTED_BYTES = 512 << 10, 128 << 10


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes of all texts; for each term of each text, by text, its place among these and how often the text
    holds it; and where each text begins."""
    texts = [t.translate(_TERMS) for t in texts]
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    full, offsets, starts, ends = common.word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    _, at, back = np.unique(full, return_index=True, return_inverse=True)
    starts, size = starts[at], (ends - starts)[at]
    hashes, of = [common.mix(full[at] + np.uint64(1))], [np.arange(len(at))]
    padded = np.concatenate([joined, np.zeros(max(PREFIXES), np.uint8)]).astype(np.uint64)
    for n in PREFIXES:
        long = np.flatnonzero(size >= n)
        h = np.zeros(len(long), np.uint64)
        for i in range(n):
            h = (h << np.uint64(8)) | padded[starts[long] + i]
        hashes.append(common.mix(h + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)))
        of.append(long)
    terms, place = np.unique(np.concatenate(hashes), return_inverse=True)
    keys, done = [], 0
    for h, words in zip(hashes, of, strict=True):
        term_of = np.full(len(at), -1, np.int64)
        term_of[words] = place[done : done + len(h)]
        done += len(h)
        found = term_of[back]
        keys.append(((owner << 32) | found)[found >= 0])
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    held = key[first]
    return terms, held & 0xFFFFFFFF, np.diff(np.append(first, len(key))), np.searchsorted(held >> 32, np.arange(len(texts) + 1))


@dataclass
class Dense:
    """Frequent terms by example, small enough to be sent: a block's matrix is made of them when texts meet it.

    place: each term's number among the frequent ones or -1; starts: where each example's terms begin; ids, tf: these terms, and
    how often the example holds them; highest: each term's largest share of an example's length, by block of so many; basis: some
    orthonormal directions of TF-IDF vectors; along, beside: each example's part along these, and the length of the rest."""

    place: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    tf: np.ndarray
    highest: np.ndarray
    block: int
    basis: np.ndarray | None = None
    along: np.ndarray | None = None
    beside: np.ndarray | None = None

    def matrix(self, lo: int, hi: int, out: np.ndarray | None = None) -> np.ndarray:
        """How often some examples hold each term."""
        if out is None:
            out = np.zeros((self.block, len(self.highest)), np.float32)
        out[:] = 0
        mine = slice(self.starts[lo], self.starts[hi])
        out.reshape(-1)[np.repeat(np.arange(hi - lo) * out.shape[1], np.diff(self.starts[lo : hi + 1])) + self.ids[mine]] = self.tf[mine]
        return out[: hi - lo]


@dataclass
class Index:
    """Examples' unit TF-IDF vectors as postings by term; like examples stand side by side, so that blocks of them differ.

    terms: sorted hashes of all terms of the examples; idf by term; ends: where each term's postings end; rows, tf: the postings,
    by term and row, as a row and how often it holds the term; norms: each example's length before it was made a unit; toxic,
    weight, hashes: by example; edges, levels: the calibration's steps; none: the score of a text without any term; k:
    neighbours. What no example holds has the highest idf and no postings: it counts in a text's length."""

    terms: np.ndarray
    idf: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    tf: np.ndarray
    norms: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    hashes: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    none: float
    k: int
    frequent: Dense | None = None
    held: np.ndarray | None = None  # all blocks' matrices, where a task has the room: see holding()

    @property
    def blocks(self) -> np.ndarray:
        """Where each term's postings begin and end."""
        return np.stack([np.append(0, self.ends[:-1]), self.ends], 1)

    @property
    def weights(self) -> np.ndarray:
        """Each posting's weight in its example's unit vector."""
        return self.tf * np.repeat(self.idf, np.diff(self.ends, prepend=0)) / self.norms[self.rows]

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's terms that an example holds, and their weights in a vector of length one."""
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        out, sizes = [], np.cumsum([len(t) for t in texts])
        while len(out) < len(texts):
            before = sizes[len(out) - 1] if out else 0
            some = texts[len(out) : max(len(out) + 1, int(np.searchsorted(sizes, before + COUNTED_BYTES, "right")))]
            found, place, tf, cuts = term_counts(some)
            at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
            term = np.where(self.terms[at] == found, at, len(self.terms))[place]
            w = tf * self.idf[term]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                known = term[a:b] < len(self.terms)
                v = w[a:b]
                out.append((term[a:b][known], v[known] / np.sqrt((v**2).sum()) if known.any() else np.zeros(0)))
        return out

    def dense(self) -> Dense:
        """The frequent terms by example. Made once, on the driver."""
        if self.frequent is None:
            n, blocks = len(self.toxic), self.blocks
            often = np.flatnonzero(blocks[:, 1] - blocks[:, 0] >= max(1.0, DENSE_SHARE * n))
            place = np.full(len(blocks), -1, np.int32)
            place[often] = np.arange(len(often))
            spans = blocks[often].tolist()
            starts = np.zeros(n + 1, np.int64)
            for lo, hi in spans:
                starts[self.rows[lo:hi].astype(np.int64) + 1] += 1
            np.cumsum(starts, out=starts)
            free = starts[:-1].copy()
            ids, tf = np.zeros(starts[-1], np.uint16 if len(often) < 1 << 16 else np.int32), np.zeros(starts[-1], self.tf.dtype)
            highest = np.zeros((len(often), -(-n // BLOCK)), np.float32)
            for i, (lo, hi) in enumerate(spans):
                rows = self.rows[lo:hi].astype(np.int64)
                to = free[rows]
                ids[to], tf[to] = i, self.tf[lo:hi]
                free[rows] = to + 1
                block = rows // BLOCK
                first = np.flatnonzero(np.diff(block, prepend=-1))
                highest[i, block[first]] = np.maximum.reduceat(self.tf[lo:hi] / self.norms[rows], first)
            d = self.frequent = Dense(place, starts, ids, tf, highest, BLOCK)
            weight = self.idf[often]
            some = np.unique(np.linspace(0, n - 1, min(n, FITTED)).astype(np.int64)) if n else np.zeros(0, np.int64)
            x = np.zeros((len(some), len(often)), np.float32)
            for i, row in enumerate(some.tolist()):
                mine = slice(starts[row], starts[row + 1])
                x[i, ids[mine]] = tf[mine] * weight[ids[mine]] / self.norms[row]
            values, u = np.linalg.eigh((x @ x.T).astype(np.float64))
            d.basis = np.linalg.qr(x.T @ u[:, np.argsort(-values)[: min(DIRECTIONS, len(often))]])[0]
            d.along, d.beside = np.zeros((d.basis.shape[1], n), np.float32), np.zeros(n, np.float32)
            for lo in range(0, n, BLOCK):
                rows = slice(lo, min(lo + BLOCK, n))
                y = d.matrix(lo, rows.stop).astype(np.float64) * weight / self.norms[rows, None]
                along = y @ d.basis
                d.along[:, rows], d.beside[rows] = along.T, np.sqrt(np.maximum(0.0, (y**2).sum(1) - (along**2).sum(1)))
        return self.frequent

    def for_workers(self) -> Index:
        """The same with no postings of the frequent terms, which workers have by example alone."""
        rare = self.dense().place < 0
        df = np.diff(self.ends, prepend=0)
        left = np.repeat(rare, df)
        return replace(self, ends=np.cumsum(df * rare), rows=self.rows[left], tf=self.tf[left])

    def holding(self) -> Index:
        """The same with all blocks' matrices, which take less time and more room: some 100 MB."""
        n, d = len(self.toxic), self.dense()
        held = np.zeros((-(-n // d.block), d.block, len(d.highest)), np.float32)
        for b, lo in enumerate(range(0, n, d.block)):
            d.matrix(lo, min(lo + d.block, n), held[b])
        return replace(self, held=held)

    def nearest(self, terms: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0, ties by hash of their text."""
        return next(self.all_nearest([(terms, w)], [skip]))

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None):
        """nearest() of each vector.

        Postings of rare terms are added up. A block's bound is the largest of these sums in it and what the frequent terms'
        maxima there allow, or, where that is less, what the examples' parts along a few directions allow. Each text first meets its few blocks of highest bound, which gives a kth cosine to beat, and then
        those blocks alone whose bound reaches it; texts that meet a block do so in one product of matrices, in single
        precision. Whoever could be among the k by that product's largest error has it taken anew in double precision, so
        the result is exact and no text's result depends on the others."""
        n = len(self.toxic)
        if not n:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in vectors)
            return
        d = self.dense()
        place, starts = d.place, d.starts
        begins, edges, shares = np.append(0, self.ends[:-1]), np.arange(0, n, d.block), 1 / self.norms
        matrix, asked = np.zeros((d.block, len(d.highest)), np.float32), np.zeros(len(d.highest))
        all_q, all_rare = (np.zeros((min(TOGETHER, len(vectors)), m), kind) for m, kind in ((len(d.highest), np.float32), (n, np.float64)))
        for start in range(0, len(vectors), TOGETHER):
            some = vectors[start : start + TOGETHER]
            q, rare = all_q[: len(some)], all_rare[: len(some)]
            q[:] = 0
            slack, along, beside = np.zeros(len(some)), np.zeros((len(some), len(d.along)), np.float32), np.zeros((len(some), 1), np.float32)
            for i, (terms, w) in enumerate(some):
                at = place[terms]
                often = at >= 0
                part = w[often] @ d.basis[at[often]]
                along[i], beside[i] = part, np.sqrt(max(0.0, (w[often] ** 2).sum() - (part**2).sum()))
                v = w * self.idf[terms]
                q[i, at[often]] = v[often]
                posts, v = terms[~often], v[~often]
                sizes = self.ends[posts] - begins[posts]
                here = np.repeat(begins[posts] - np.cumsum(sizes) + sizes, sizes)
                here += np.arange(len(here))
                np.multiply(np.bincount(self.rows[here], self.tf[here] * np.repeat(v, sizes), n), shares, out=rare[i])
                slack[i] = 4 * (often.sum() + 4) * 2.0**-24  # of a sum without negative parts
                if skip is not None and skip[start + i] >= 0:
                    rare[i, skip[start + i]] = -2.0  # no sum reaches 0
            bound = q @ d.highest + np.maximum.reduceat(rare, edges, axis=1)
            for b in range(0, bound.shape[1], 16):
                cols = slice(b * d.block, (b + 16) * d.block)
                found = along @ d.along[:, cols]
                found += beside * d.beside[cols]
                found += rare[:, cols]
                found = np.maximum.reduceat(found, np.arange(0, found.shape[1], d.block), axis=1) + 1e-5  # more than its rounding
                np.minimum(bound[:, b : b + 16], found, out=bound[:, b : b + 16])
            slack *= np.maximum(1.0, bound.max(1))

            def meet(which: np.ndarray, q=q, rare=rare):
                """The texts that meet a block, its first example, and their cosines."""
                for b in np.flatnonzero(which.any(0)).tolist():
                    lo, hi = b * d.block, min((b + 1) * d.block, n)
                    held = d.matrix(lo, hi, matrix) if self.held is None else self.held[b, : hi - lo]
                    who = np.flatnonzero(which[:, b])
                    yield who, lo, q[who] @ held.T * shares[lo:hi] + rare[who, lo:hi]

            first = np.zeros(bound.shape, bool)
            few = min(FIRST, bound.shape[1])
            np.put_along_axis(first, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
            met, so_far = np.full((len(some), few * d.block), -1.0), np.zeros(len(some), np.int64)
            near: list[list[np.ndarray]] = [[], [], []]  # texts, rows and cosines that may be among the k

            def note(who, lo, found, least, near=near) -> None:
                i, j = np.nonzero(found > least[who, None])
                for x, y in zip(near, (who[i], lo + j, found[i, j]), strict=True):
                    x.append(y)

            blocks = []
            for who, lo, found in meet(first):
                met[who[:, None], so_far[who, None] * d.block + np.arange(found.shape[1])] = found
                so_far[who] += 1
                blocks.append((who, lo, found))
            kth = np.partition(met, -self.k, axis=1)[:, -self.k] if met.shape[1] > self.k else np.full(len(some), -1.0)
            least = np.maximum(0.0, kth - slack)
            for x in blocks:
                note(*x, least)
            for x in meet(~first & (bound >= (kth - slack)[:, None]) & (bound > 0)):
                note(*x, least)
            texts, rows, about = map(np.concatenate, near) if near[0] else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((rows, texts))
            ends = np.searchsorted(texts[order], np.arange(len(some) + 1))
            rows, about = rows[order], about[order]
            for i, (terms, w) in enumerate(some):
                mine, its = rows[ends[i] : ends[i + 1]], about[ends[i] : ends[i + 1]]
                if len(mine) > self.k:
                    mine = mine[its >= np.partition(its, len(its) - self.k)[len(its) - self.k] - slack[i]]
                at = place[terms]
                often = at >= 0
                asks = (w * self.idf[terms])[often]
                if self.held is not None:
                    sums = self.held[mine[:, None] // d.block, mine[:, None] % d.block, at[often]].astype(np.float64) @ asks
                else:
                    asked[at[often]] = asks
                    sizes = starts[mine + 1] - starts[mine]
                    here = np.repeat(starts[mine + 1] - np.cumsum(sizes), sizes)
                    here += np.arange(len(here))
                    sums = np.bincount(np.repeat(np.arange(len(mine)), sizes), asked[d.ids[here]] * d.tf[here], len(mine))
                    asked[at[often]] = 0
                sims = np.round(rare[i, mine] + sums * shares[mine], 9)
                mine, sims = mine[sims > 0], sims[sims > 0]
                best = np.lexsort((self.hashes[mine], -sims))[: self.k]
                yield mine[best], sims[best]

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic examples, each weighted by its class's share and by its angle: 1 / (0.1 + distance)."""
        w = self.weight[rows] / (0.1 + np.sqrt(np.maximum(0.0, 2 - 2 * sims)))
        return float((w * self.toxic[rows]).sum() / w.sum())

    def calibrated(self, raw: float) -> float:
        return float(self.levels[np.searchsorted(self.edges, raw, "left")])

    def scores(self, texts: list[bytes]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score of each text, its neighbours and their cosines."""
        if not len(self.toxic):
            return [(self.none, np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        different = list(dict.fromkeys(texts))
        found = {t: ((self.calibrated(self.vote(*x)) if len(x[0]) else self.none), *x) for t, x in zip(different, self.all_nearest(self.vectors(different)), strict=True)}
        return [found[t] for t in texts]


def _steps(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising step function through the weighted rates (pool adjacent violators): upper edges and levels."""
    pools: list[list[float]] = []  # toxic weight, weight, highest raw
    for i in np.argsort(raw, kind="stable"):
        if pools and pools[-1][2] == raw[i]:
            pools[-1][0] += w[i] * y[i]
            pools[-1][1] += w[i]
        else:
            pools.append([w[i] * y[i], w[i], raw[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, top = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, top]
    if not pools:
        return np.zeros(0), np.zeros(1)
    levels = np.array([p[0] / p[1] for p in pools])
    edges = np.array([(p[2] + q) / 2 for p, q in zip(pools[:-1], [raw[raw > p[2]].min() for p in pools[:-1]], strict=True)])
    return edges, levels


def side_by_side(vectors, df: np.ndarray, n: int, terms: int = 256, centres: int = 96, rounds: int = 4) -> np.ndarray:
    """An order in which like examples are neighbours: by their nearest of a few spherical means over the most frequent terms.
    Any order gives the same neighbours; this one lets block maxima differ. Depends on the examples alone."""
    top = np.argsort(-df[:-1], kind="stable")[:terms]
    at = np.full(len(df), -1)
    at[top] = np.arange(len(top))
    x = np.zeros((n, len(top)), np.float32)
    for i, (ids, w) in enumerate(vectors):
        mine = at[ids]
        x[i, mine[mine >= 0]] = w[mine >= 0]
    mean = x[np.linspace(0, n - 1, min(n, centres)).astype(np.int64)] if n else x
    near = np.zeros(n, np.int64)
    for _ in range(rounds if n else 0):
        mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        near = (x @ mean.T).argmax(1)
        for j in np.unique(near).tolist():
            mean[j] = x[near == j].mean(0)
    return np.lexsort((-(x**2).sum(1), near))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 9000, k: int = 16) -> Index:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic 0/1); a document labelled more than once has its highest
    label. Bounds: max_toxic and max_clean different texts, those of lowest xxhash64. All their terms are indexed: the hashes
    and counts of these, and nothing else, come to the driver. Rows with null id, text or label take no part; without
    examples every score is 0."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "toxic")
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("h"))
    marked = scratch.put(texts.select("doc_id", "h").join(marks, "doc_id").select("h", "toxic"))  # texts stay where they are
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = []
    for label, most in ((0, max_clean), (1, max_toxic)):
        picks += [(r["h"], label) for r in marked.where(F.col("toxic") == label).select("h").distinct().orderBy("h").limit(most).collect()]
    picks = spark.createDataFrame(picks, "h long, toxic int")
    sample = scratch.put(texts.select("text", "h").join(F.broadcast(picks), "h").dropDuplicates(["h", "toxic"]))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def terms_of():
        def f(piece: pa.RecordBatch):
            h, place, _, _ = term_counts(common.encoded(common.column(piece, "text")))
            return [h.view(np.int64), np.bincount(place, minlength=len(h))]

        return f

    held = common.over_batches(sample.select("text"), terms_of, "term long, n long", piece_bytes=TERMS_OF_BYTES).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms = np.array(held["term"]).view(np.uint64)
    order = np.argsort(terms)
    terms, df = terms[order], np.append(np.array(held["n"])[order], 0).astype(np.int64)
    del held, order
    sent = spark.sparkContext.broadcast(terms)

    def counts_of():
        terms = sent.value

        def f(piece: pa.RecordBatch):
            h, place, tf, cuts = term_counts(common.encoded(common.column(piece, "text")))
            ids = np.searchsorted(terms, h).astype("<i4")[place]
            out = []
            for i in range(piece.num_rows):
                mine = slice(cuts[i], cuts[i + 1])
                out.append((common.packed(np.diff(ids[mine], prepend=np.int32(0)).astype("<i4")), common.packed(tf[mine].astype("<u4"))))
            return [common.column(piece, "h"), common.column(piece, "toxic"), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))]

        return f

    found = common.over_batches(sample.select("text", "h", "toxic"), counts_of, "h long, toxic int, ids binary, tf binary", piece_bytes=TERMS_OF_BYTES).toArrow()
    sent.unpersist()
    n = found.num_rows
    idf = np.log((1 + n) / (1 + df)) + 1
    ends = np.cumsum(df)
    free = ends - df  # where each term's next posting goes
    rows, held = np.zeros(int(df.sum()), np.uint16 if n < 1 << 16 else np.int32), np.zeros(int(df.sum()), np.uint32)
    norms = np.ones(n)
    h, toxic = (np.array(found[c], np.int64) for c in ("h", "toxic"))

    def vectors_of(order):
        for i in order.tolist():
            ids, tf = np.cumsum(common.unpacked(found["ids"][i].as_py(), "<i4")), common.unpacked(found["tf"][i].as_py(), "<u4")
            w = tf * idf[ids]
            yield ids, tf, np.sqrt((w**2).sum()) if len(w) else 1.0

    plain = np.lexsort((toxic, h))
    order = plain[side_by_side(((ids, tf * idf[ids] / norm) for ids, tf, norm in vectors_of(plain)), df, n)]
    for i, (ids, tf, norm) in enumerate(vectors_of(order)):
        rows[free[ids]], held[free[ids]], norms[i] = i, tf, norm
        free[ids] += 1
    held = held.astype(np.min_scalar_type(held.max(initial=0)))  # one byte, as a rule
    h, toxic = h[order], toxic[order]
    del found
    weight = np.array([totals[y] / sizes[y] for y in toxic.tolist()], np.float64)
    index = Index(terms, idf, ends, rows, held, norms, toxic.astype(np.float64), weight, h, np.zeros(0), np.zeros(1), 0.0, k)
    if not n:
        return index
    # calibration: every example scored by the others
    sent = spark.sparkContext.broadcast(index.for_workers())

    def votes_of():
        ix = sent.value
        own = {key: i for i, key in enumerate(zip(ix.hashes.tolist(), ix.toxic.tolist(), strict=True))}

        def f(piece: pa.RecordBatch):
            mine = [own[key] for key in zip(common.column(piece, "h").to_pylist(), common.column(piece, "toxic").to_pylist(), strict=True)]
            near = ix.all_nearest(ix.vectors(common.encoded(common.column(piece, "text"))), mine)
            return [np.array(mine), pa.array([ix.vote(*x) if len(x[0]) else None for x in near], pa.float64())]

        return f

    votes = {r["i"]: r["raw"] for r in common.over_batches(sample.select("text", "h", "toxic"), votes_of, "i long, raw double", piece_bytes=TERMS_OF_BYTES // 2).collect()}
    sent.unpersist()
    kept = [i for i in range(n) if votes[i] is not None]
    blank = [i for i in range(n) if votes[i] is None]
    index.edges, index.levels = _steps(np.array([votes[i] for i in kept]), index.toxic[kept], index.weight[kept]) if kept else (np.zeros(0), np.zeros(1))
    if blank and index.weight[blank].sum():
        index.none = float((index.weight * index.toxic)[blank].sum() / index.weight[blank].sum())
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), and the evidence: similar (hashes of the nearest examples' texts), cosines and labels.

    The index is sent to the workers; its size is bounded by fit()'s parameters. Null and empty texts have the score of
    texts without any term; repeated rows are repeated; an empty table gives an empty one; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(index.for_workers())

    def make():
        ix = sent.value.holding()

        def f(piece: pa.RecordBatch):
            found = ix.scores(common.encoded(common.column(piece, "t")))
            return [
                common.column(piece, "k"), np.array([x[0] for x in found], np.float64), pa.array([ix.hashes[x[1]] for x in found], pa.list_(pa.int64())),
                pa.array([x[2] for x in found], pa.list_(pa.float64())), pa.array([ix.toxic[x[1]].astype(np.int32) for x in found], pa.list_(pa.int32())),
            ]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = common.over_batches(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), make, f"k {kind}, score double, similar array<long>, cosines array<double>, labels array<int>", "t", piece_bytes=2 * TERMS_OF_BYTES)
    return out.withColumnRenamed("k", id_col)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    index = fit(docs, training_labels(common.table(spark, sf_dir, "labels")))
    return score(docs, index).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep(docs: DataFrame, index: Index, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score under the threshold, with all their columns, in one narrow pass. For pipelines, where memory is
    short: a task makes a block's matrix when it needs it, and takes small pieces."""
    sent = docs.sparkSession.sparkContext.broadcast(index.for_workers())

    def run(batches):
        common.drop_model()
        ix = sent.value
        for batch in batches:
            for piece in common.pieces(batch, text_col, TERMS_OF_BYTES // 2):
                yield piece.filter(pa.array([x[0] < threshold for x in ix.scores(common.encoded(common.column(piece, text_col)))], pa.bool_()))
        ix = batch = piece = None
        common.trim()

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
