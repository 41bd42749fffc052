"""Pairs of columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .missingness import digest, missing_flag_correlation

#: Columns that a table of all pairs takes if not told otherwise.
MOST_COLUMNS = 50
#: Columns up to which every pair is an expression of one aggregation (more are too many for compiled code); columns of a block
#: beyond, and bytes of a task's sums.
FEW_COLUMNS, BLOCK_COLUMNS, SUM_BYTES = 4, 128, 64 << 20
#: Rows that set the middle and scale of a column, from which its sums are taken; groups that partial sums are added up in first.
MIDDLE_ROWS, ADDED_FIRST, ROWS_AT_ONCE = 1000, 64, 2048


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, most: int | None = MOST_COLUMNS) -> DataFrame:
    """(left, right, correlation) of the first numeric columns (None: of all), pairwise complete, from one aggregation."""
    columns = list(columns or C.numeric_columns(df, booleans=True))[:most]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return C.rows_of(df, [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), C.correlation(C.as_number(df, a), C.as_number(df, b)).alias("correlation")) for a, b in pairs])


def _products(z: np.ndarray, there: np.ndarray, i: slice, j: slice) -> np.ndarray:
    """Of two blocks of columns, over rows where both are there: counts, sums and squares of either side, and products."""
    a, b, m, k = z[:, i], z[:, j], there[:, i], there[:, j]
    return np.stack([m.T @ k, a.T @ k, m.T @ b, (a * a).T @ k, m.T @ (b * b), a.T @ b])


def _coefficients(sums: np.ndarray) -> np.ndarray:
    """Pearson of each pair; NaN where a side does not vary."""
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(all="ignore"):
        vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
        out = (sxy / n - sx / n * sy / n) / np.sqrt(vx * vy)
        return np.where((vx > 1e-12 * sxx / n) & (vy > 1e-12 * syy / n), np.clip(out, -1, 1), np.nan)


def correlations(df: DataFrame, columns: Sequence[str], values: Sequence[Column] | None = None, block: int = BLOCK_COLUMNS) -> DataFrame:
    """(left, right, correlation) of every two of any number of columns (or of values named so), over the rows where both are
    there; null where a side does not vary.

    Columns are cut to blocks. A task multiplies its rows' masked values block by block and sends one set of sums for every two
    blocks; these are added in some groups and then over all, so nothing but sums is shuffled. So many block pairs share a
    scan as their sums fit SUM_BYTES. Sums are taken from the middle of some rows, as those of large numbers would lose digits."""
    columns = list(columns)
    values = list(values) if values is not None else [C.as_number(df, c) for c in columns]
    rows = df.select(F.transform(F.array(*values), lambda x: F.when(~F.isnan(x), x)).alias("v"))
    seen = np.array([[np.nan if x is None else x for x in r["v"]] for r in rows.limit(MIDDLE_ROWS).collect()], float).reshape(-1, len(columns))
    some = np.isfinite(seen)
    count = np.maximum(1, some.sum(0))
    middle = np.where(some, seen, 0).sum(0) / count
    scale = np.sqrt((np.where(some, seen - middle, 0) ** 2).sum(0) / count)
    scale[~(scale > 0)] = 1.0
    edges = list(range(0, len(columns), block))
    slices = [slice(a, min(a + block, len(columns))) for a in edges]
    pairs = list(combinations_with_replacement(range(len(slices)), 2))
    at_once = max(1, SUM_BYTES // (48 * block * block))
    schema = "p int, q int, sums binary"

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in table["sums"].to_pylist())
        return pa.table({"p": table["p"][:1], "q": table["q"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    def told(table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        i, j = slices[p], slices[q]
        sums = sum(np.frombuffer(x, float) for x in table["sums"].to_pylist()).reshape(6, i.stop - i.start, j.stop - j.start)
        r = _coefficients(sums)
        left, right = np.nonzero(np.add.outer(np.arange(i.start, i.stop), np.zeros(j.stop - j.start)) < np.arange(j.start, j.stop))
        found = r[left, right]
        return pa.table({"left": [columns[i.start + x] for x in left.tolist()], "right": [columns[j.start + x] for x in right.tolist()], "correlation": pa.array(found, mask=np.isnan(found))}, schema=pa.schema([("left", pa.string()), ("right", pa.string()), ("correlation", pa.float64())]))

    out = None
    for start in range(0, len(pairs), at_once):
        mine = pairs[start : start + at_once]

        def run(batches, mine=mine):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    v = batch.column(0).slice(at, ROWS_AT_ONCE)
                    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), len(columns))
                    there = np.isfinite(x)
                    z = np.where(there, (x - middle) / scale, 0.0)
                    there = there.astype(float)
                    for p, q in mine:
                        found = _products(z, there, slices[p], slices[q])
                        sums[p, q] = sums[p, q] + found if (p, q) in sums else found
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in sums], pa.int32()), pa.array([q for _, q in sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["p", "q", "sums"])

        part = rows.mapInArrow(run, schema).withColumn("first", F.spark_partition_id() % ADDED_FIRST)
        part = part.groupBy("p", "q", "first").applyInArrow(lambda t: summed(t.drop_columns("first")), schema).groupBy("p", "q").applyInArrow(told, "left string, right string, correlation double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "left string, right string, correlation double")


def matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """correlations(), of few columns in the JVM."""
    return correlation_matrix(df, columns) if len(columns) <= FEW_COLUMNS else correlations(df, columns)


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every two columns' missing flags, of any number of columns."""
    flags = [C.name(c).isNull().cast("double") for c in columns]
    return missing_flag_correlation(df, columns) if len(columns) <= MOST_COLUMNS else correlations(df, columns, flags)


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Strongest first; ties by name. Of any number of columns."""
    found = matrix(df, list(columns or C.numeric_columns(df, booleans=True)))
    return found.where(F.abs("correlation") >= threshold).orderBy(F.desc(F.abs("correlation")), "left", "right")


def column_fingerprints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, a, b): 128 bits of each column that don't depend on the order of rows: hashes of a row's digest and the column's
    value, added up bit by bit. Equal columns have equal ones. One scan, whatever the number of columns."""
    marks = F.array(*[F.struct(F.xxhash64(F.lit(3), "__a", C.name(c)).alias("a"), F.xxhash64(F.lit(4), "__b", C.name(c)).alias("b")) for c in columns])
    rows = df.withColumns({"__a": digest(df, 1), "__b": digest(df, 2)}).select(F.posexplode(marks).alias("i", "h"))
    found = rows.groupBy("i").agg(F.bit_xor("h.a").alias("a"), F.bit_xor("h.b").alias("b"))
    return found.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("column"), "a", "b")


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(left, right) of the numeric columns (or any number of given ones) of one type that are equal in every row, nulls included.

    Columns of equal fingerprints are found in one scan, and in a second each of them is held against the first of its group. On
    an empty table all columns of a type are equal."""
    columns = list(columns or C.numeric_columns(df, booleans=True))
    empty = "left string, right string"
    marks = {r["column"]: (r["a"], r["b"]) for r in column_fingerprints(df, columns).collect()} if len(columns) > 1 else {}
    groups: dict[tuple, list[str]] = {}
    for c in columns:
        groups.setdefault((df.schema[c].dataType.simpleString(), marks.get(c)), []).append(c)
    likely = [g for g in groups.values() if len(g) > 1]
    if not likely:
        return df.sparkSession.createDataFrame([], empty)
    others = [(g[0], c) for g in likely for c in g[1:]]
    same = C.rows_of(df, [F.struct(F.lit(c).alias("column"), F.coalesce(F.bool_and(C.name(a).eqNullSafe(C.name(c))), F.lit(True)).alias("same")) for a, c in others])
    true = {r["column"] for r in same.collect() if r["same"]}
    kept = [[c for c in g if c == g[0] or c in true] for g in likely]
    return df.sparkSession.createDataFrame([(a, b) for g in kept for i, a in enumerate(g) for b in g[i + 1 :]], empty)
