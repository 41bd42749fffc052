"""Exact top-k by inner product: distributed histogram selection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

QUERY_ROWS, CANDIDATE_ROWS, BINS = 1024, 4096, 512
#: A task holds so many blocks of candidates and of queries at most; where there are few blocks, both sides are cut to so many groups.
TILE_BLOCKS, LEAST_GROUPS = 64, 4
#: Histograms of one block of queries that are summed at once.
SUMMED = 64
_MIN, _MAX = -(2**63), 2**63 - 1


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and components as doubles, of vectors without null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.col(id_col).isNotNull()
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) of any finite double, exactly."""
    return math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale + math.floor((x - int(x)) * scale)


class Block:
    """Ids and floor(scale * x) of their vectors: as floating point, exact where it is under 2**53, and modulo 2**64."""

    def __init__(self, row: dict, side: str, scale: int):
        self.ids = np.frombuffer(row[f"{side}ids"], "<i8")
        kind, self.scale = row[f"{side}kind"], scale
        v = np.frombuffer(row[f"{side}vals"], f"<{kind}").reshape(len(self.ids), row["dim"])
        self.raw = v if kind == "f8" else None
        if self.raw is None:
            self.floats = v.astype(np.float64)
        else:
            with np.errstate(over="ignore"):
                self.floats = np.floor(v * scale)
        self.largest = float(np.abs(self.floats).max(initial=0.0))
        self._single = None

    def single(self) -> np.ndarray:
        if self._single is None:
            self._single = self.floats.astype(np.float32)
        return self._single

    def wrapped(self) -> np.ndarray:
        """The whole numbers modulo 2**64."""
        if self.largest < 2.0**62:
            return self.floats.astype(np.int64)
        flat = [_whole(x, self.scale) % 2**64 for x in self.raw.ravel().tolist()]
        return np.array(flat, np.uint64).view(np.int64).reshape(self.raw.shape)

    def row(self, i: int) -> list[int]:
        return [int(x) for x in self.floats[i]] if self.raw is None else [_whole(x, self.scale) for x in self.raw[i].tolist()]


def scores(q: Block, c: Block) -> np.ndarray:
    """Exact inner products. Floating point where no sum can be inexact; else integers modulo 2**64, which are right for every
    sum that fits a long. Sums that may not, by their size in floating point and its error, are taken anew in whole numbers, and one that
    does not fit raises OverflowError. A query's own id is left out of this."""
    dim = q.floats.shape[1]
    most = q.largest * c.largest * dim
    if most < 2.0**24:
        return (q.single() @ c.single().T).astype(np.int64)
    if most < 2.0**53:
        return (q.floats @ c.floats.T).astype(np.int64)
    s = q.wrapped() @ c.wrapped().T
    with np.errstate(over="ignore", invalid="ignore"):
        error = (dim + 2) * 2.0**-51 * (np.abs(q.floats) @ np.abs(c.floats).T)
        sure = np.abs(q.floats @ c.floats.T) + error < 2.0**63
    for i, j in zip(*np.nonzero(~sure & (q.ids[:, None] != c.ids[None, :])), strict=True):
        exact = sum(a * b for a, b in zip(q.row(i), c.row(j), strict=True))
        if not _MIN <= exact <= _MAX:
            raise OverflowError(f"the score of {q.ids[i]} and {c.ids[j]} does not fit a long")
        s[i, j] = exact
    return s


def _blocks(vectors: DataFrame, rows: int, scale: int, side: str) -> DataFrame:
    """Packs vectors to blocks: dimension, ids, and values in the smallest type that holds them (as given, where no 32-bit integer
    does), with the largest component and length. One narrow pass; blocks don't cross tasks."""
    names = ["dim", f"{side}ids", f"{side}kind", f"{side}vals", "most", "length", f"{side}b"]

    def run(batches):
        held: dict[int, list] = {}

        def full(dim):
            ids, x = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            with np.errstate(over="ignore"):
                y = np.floor(x * scale)
                most, length = float(np.abs(y).max(initial=0.0)), float(np.sqrt((y**2).sum(1)).max(initial=0.0))
            kind = next((f"i{n}" for n in (1, 2, 4) if most < 2.0 ** (8 * n - 1)), "f8")
            vals = x if kind == "f8" else y
            key = int(common.mix(np.array([np.bitwise_xor.reduce(common.mix(ids.view(np.uint64) + np.uint64(dim)))]))[0] >> np.uint64(1))
            values = [dim, ids.astype("<i8").tobytes(), kind, vals.astype(f"<{kind}").tobytes(), most, length, key]
            types = [pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            ids, v = np.array(common.column(batch, "id")), common.column(batch, "v")
            sizes, flat = np.array(v.value_lengths()), np.array(v.flatten(), np.float64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                values = flat[starts[mine][:, None] + np.arange(dim)]
                for at in range(0, len(mine), rows):
                    held.setdefault(dim, []).append((ids[mine[at : at + rows]], values[at : at + rows]))
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield full(dim)
        for dim in list(held):
            yield full(dim)

    return vectors.mapInArrow(run, f"dim long, {side}ids binary, {side}kind string, {side}vals binary, most double, length double, {side}b long")


def _width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Width of each query's bins, so that BINS of them cover lo to hi; without sign, as the range may be all longs."""
    return (hi.view(np.uint64) - lo.view(np.uint64)) // np.uint64(BINS) + np.uint64(1)


_STATE = "dim long, qb long, qids binary, qkind string, qvals binary, lo binary, hi binary, need binary, open boolean"


def _state(row: dict, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> pa.Table:
    fields = [row["dim"], row["qb"], row["qids"], row["qkind"], row["qvals"], *(x.astype("<i8").tobytes() for x in (lo, hi, need)), bool((lo < hi).any())]
    names = [x.split()[0] for x in _STATE.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
    return pa.table([pa.array([v], t) for v, t in zip(fields, types, strict=True)], names)


def _begin(k: int, scale: int):
    """The range in which all scores of each query lie: |q.c| is at most sum|q| * max|c| and |q| * |c|."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q = Block(row, "q", scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.minimum(np.abs(q.floats).sum(1) * row["most"], np.sqrt((q.floats**2).sum(1)) * row["length"]) * (1 + 1e-9) + 1
                fits = top < 2.0**62  # false where it isn't a number
                hi = np.where(fits, np.where(fits, top, 0).astype(np.int64), _MAX)
                yield from _state(row, np.where(fits, -hi, _MIN), hi, np.full(len(hi), k, np.int64)).to_batches()

    return run


def _count(scale: int):
    """The histograms of a tile: for each block of queries, over all the tile's candidates."""

    def f(key, cands: pa.Table, queries: pa.Table) -> pa.Table:
        common.lean()
        blocks = [Block(row, "c", scale) for row in cands.to_pylist()]
        out = []
        for row in queries.to_pylist() if blocks else []:
            q = Block(row, "q", scale)
            lo, hi = (np.frombuffer(row[n], "<i8") for n in ("lo", "hi"))
            width, h = _width(lo, hi), np.zeros(len(lo) * BINS, np.int64)
            for c in blocks:
                s = scores(q, c)
                where, at = np.nonzero((s >= lo[:, None]) & (s <= hi[:, None]) & (c.ids[None, :] != q.ids[:, None]))
                b = (s[where, at].view(np.uint64) - lo[where].view(np.uint64)) // width[where]
                h += np.bincount(where * BINS + b.astype(np.int64), minlength=len(h))
            out.append((row["dim"], row["qb"], key[1].as_py(), common.packed(h.astype("<i8"))))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("dim", pa.int64()), ("qb", pa.int64()), ("part", pa.int64()), ("hist", pa.binary())))})

    return f


def _added(key, t):  # without hints, which Spark would try to read
    h = sum(common.unpacked(x, "<i8") for x in t["hist"].to_pylist())
    return pa.table({"dim": t["dim"][:1], "qb": t["qb"][:1], "part": pa.array([key[2].as_py()], pa.int64()), "hist": pa.array([common.packed(h)], pa.binary())})


def _narrow(key, states: pa.Table, hists: pa.Table) -> pa.Table:
    """Each query's range becomes the bin that holds its kth score."""
    row = next(iter(states.to_pylist()), None)
    if row is None:
        return pa.Table.from_batches([], _state({"dim": 0, "qb": 0, "qids": b"", "qkind": "", "qvals": b""}, *[np.zeros(0, np.int64)] * 3).schema)
    lo, hi, need = (np.frombuffer(row[n], "<i8") for n in ("lo", "hi", "need"))
    h = np.zeros(len(lo) * BINS, np.int64)
    for x in hists["hist"].to_pylist():
        h += common.unpacked(x, "<i8")
    above = h.reshape(len(lo), BINS)[:, ::-1].cumsum(1)[:, ::-1]  # candidates in this bin or a higher one
    enough = above >= need[:, None]
    short, done = ~enough.any(1), lo >= hi  # short: fewer candidates than k, all of them are wanted
    b = np.where(short, 0, BINS - 1 - enough[:, ::-1].argmax(1))
    higher = np.where(b + 1 < BINS, np.take_along_axis(above, np.minimum(b + 1, BINS - 1)[:, None], 1)[:, 0], 0)
    width = _width(lo, hi)
    start = lo.view(np.uint64) + b.astype(np.uint64) * width
    room = np.minimum(width - np.uint64(1), hi.view(np.uint64) - start)
    nlo, nhi = start.view(np.int64), (start + room).view(np.int64)
    return _state(row, np.where(done, lo, np.where(short, _MIN, nlo)), np.where(done, hi, np.where(short, _MIN, nhi)), np.where(done | short, need, need - higher))


def _choose(k: int, scale: int):
    """A tile's scores above each query's kth, and of those equal to it the k of smallest ids."""

    def f(key, cands: pa.Table, queries: pa.Table) -> pa.Table:
        common.lean()
        blocks = [Block(row, "c", scale) for row in cands.to_pylist()]
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for row in queries.to_pylist() if blocks else []:
            q = Block(row, "q", scale)
            kth, ties = np.frombuffer(row["lo"], "<i8"), [np.zeros((2, 0), np.int64)]
            for c in blocks:
                s = scores(q, c)
                other = c.ids[None, :] != q.ids[:, None]
                where, at = np.nonzero((s > kth[:, None]) & other)
                for x, y in zip(out, (q.ids[where], c.ids[at], s[where, at]), strict=True):
                    x.append(y)
                where, at = np.nonzero((s == kth[:, None]) & other)
                ties.append(np.stack([where, c.ids[at]]))
                if sum(x.shape[1] for x in ties) > 4 * k * len(kth):
                    ties = [_first_ids(np.concatenate(ties, 1), k)]
            where, ids = _first_ids(np.concatenate(ties, 1), k)
            for x, y in zip(out, (q.ids[where], ids, kth[where]), strict=True):
                x.append(y)
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return f


def _first_ids(ties: np.ndarray, k: int) -> np.ndarray:
    """Of (query, id) those k of each query with the smallest ids."""
    ties = ties[:, np.lexsort((ties[1], ties[0]))]
    return ties[:, np.arange(ties.shape[1]) - np.searchsorted(ties[0], ties[0]) < k]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all candidates but those of its
    own id; ties go to the smaller id. Fewer candidates give fewer rows.

    Blocks of queries and of candidates are dealt to tiles, and a task holds one tile of either side at a time. In each round a
    tile sums a histogram for every query over the range in which the query's kth score still lies; the sums over all
    tiles tell the bin of that score, which is the next round's range, until it is one number. The last pass lets through
    only scores above it, and, of a tile's scores equal to it, those k with the smallest ids; a window breaks the ties. So
    no list of scores is ever kept, nothing depends on the order of tasks, and what moves is a block's vectors for each
    group of the other side, and one histogram for each block of queries and group of candidates. The number of rounds is
    log(range)/log(512).

    Vectors that are null or hold null or non-finite components take no part, and neither do rows without id. All others
    do, of any size: a score that doesn't fit a long raises OverflowError. Only vectors of one length meet, so empty ones meet
    empty ones, with score 0. A query id that is repeated is searched once, with the first of its vectors in array order;
    repeated candidates count each. Empty tables give an empty result; other columns are not read."""
    spark = queries.sparkSession
    scratch = common.Scratch(spark, "topk")
    q = _vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    qb = scratch.put(_blocks(q, QUERY_ROWS, scale, "q").drop("most", "length"))
    cb = scratch.put(_blocks(_vectors(candidates, id_col, vec_col), CANDIDATE_ROWS, scale, "c"))
    bound = cb.groupBy("dim").agg(F.max("most").alias("most"), F.max("length").alias("length"))  # a row for each length of vectors
    state = scratch.put(qb.join(bound, "dim").mapInArrow(_begin(k, scale), _STATE))
    groups = lambda df: (lambda n: max(-(-n // TILE_BLOCKS), min(n, LEAST_GROUPS), 1))(df.count())
    n_c, n_q = groups(cb), groups(qb)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = cb.select("dim", F.pmod("cb", F.lit(n_c)).cast("long").alias("cg"), each(n_q).alias("qg"), "cids", "ckind", "cvals")

    def tiles(states: DataFrame):
        asked = states.select("*", F.pmod("qb", F.lit(n_q)).cast("long").alias("qg"), each(n_c).alias("cg"))
        return dealt.groupBy("dim", "cg", "qg").cogroup(asked.groupBy("dim", "cg", "qg"))

    while state.where("open").limit(1).count():
        hists, parts = tiles(state.where("open")).applyInArrow(_count(scale), "dim long, qb long, part long, hist binary"), n_c
        while parts > SUMMED:
            hists = hists.groupBy("dim", "qb", F.floor(F.col("part") / SUMMED)).applyInArrow(_added, "dim long, qb long, part long, hist binary")
            parts = -(-parts // SUMMED)
        state = scratch.put(state.groupBy("dim", "qb").cogroup(hists.groupBy("dim", "qb")).applyInArrow(_narrow, _STATE))
    found = tiles(state).applyInArrow(_choose(k, scale), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
