"""Value counts and what follows from them: positions, exact quantiles, average ranks, quantile bins.

A near-unique column has as many values as rows, so a large column is never sorted in one task: values are cut to ranges at
approximate quantiles, counted by range, and only numbered within their range. Columns that a task can sort have one range."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_number, name

#: Ranges that a column's values are cut to at once, and bytes of the sources up to which a range is left whole.
RANGES, BYTES_OF_A_RANGE = 32, 16 << 20
#: Columns up to which each is counted by a pass of its own, if its table is read straight from files.
PASSES = 50
#: Spark's estimate of a source that it knows nothing of is as large as a number can be.
UNKNOWN = 1 << 60


def long_numbers(df: DataFrame, columns: Sequence[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """(column, value) rows of the columns' values that are not null, beside the kept ones; one scan of the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_number(df, c).alias("value")) for c in columns])
    rows = df.select(*[c.alias(k) for k, c in (keep or {}).items()], F.explode(pairs).alias("p"))
    return rows.select(*(keep or {}), "p.column", "p.value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of numeric columns."""
    return long_numbers(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def scanned(df: DataFrame) -> bool:
    """Whether rows come straight from files or a cache, at most chosen and computed on: a pass for each column then reads that column
    alone, so all of them read no more than one pass."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.getClass().getSimpleName() in ("LogicalRelation", "InMemoryRelation")


def by_passes(df: DataFrame, columns: Sequence[str]) -> bool:
    return 0 < len(columns) <= PASSES and scanned(df)


def united(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


@contextlib.contextmanager
def held(counts: DataFrame) -> Iterator[DataFrame]:
    """Counts that several passes are made of, taken once and let go at the end (on disk where they don't fit). What is made of
    them has to be taken by then. Their size is known from then on, not estimated from the sources."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a union has so many for each column
    counts = counts.coalesce(tasks).persist()
    try:
        counts.count()
        yield counts
    finally:
        counts.unpersist()


def value_table(df: DataFrame, columns: Sequence[str], y: Column | None = None) -> DataFrame:
    """(column, value, number, n, n1, n0) of columns of any type: each value as text (null is one) and, of numbers and
    booleans, as a double; its rows, and those of class 1 and 0 of a response. What cardinality, frequencies, quantiles,
    outliers, ranks, bins and category rates are made of.

    Few columns of files are counted one by one in their own type, and only different values are written as texts; others
    are unpivoted in one scan."""
    plain = (T.NumericType, T.BooleanType)
    real = (T.DoubleType, T.FloatType)
    text = lambda d, c: (name(c) + F.lit(0.0) if isinstance(d.schema[c].dataType, real) else name(c)).cast("string").alias("value")  # noqa: E731  # -0.0 is 0.0
    number = lambda d, c: (as_number(d, c) if isinstance(d.schema[c].dataType, plain) else F.lit(None).cast("double")).alias("number")
    given = (F.lit(None).cast("double") if y is None else y.cast("double")).alias("y")
    n = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")]
    if by_passes(df, columns):
        counted = [(c, df.select(name(c).alias("v"), given).groupBy("v").agg(*n)) for c in columns]
        return united([d.select(F.lit(c).alias("column"), text(d, "v"), number(d, "v"), "n", "n1", "n0") for c, d in counted])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(df, c), number(df, c)) for c in columns])
    rows = df.select(given, F.explode(pairs).alias("p")).select("y", "p.*")
    return rows.groupBy("column", "value", "number").agg(*n)


def numbers_of(counts: DataFrame, columns: Sequence[str], classes: bool = False) -> DataFrame:
    """(column, value, n) of a value table's numbers; with classes, of the rows that have one, and n1. Whole numbers that are one
    as doubles are one value."""
    rows = counts.where(F.col("column").isin(*columns) & F.col("number").isNotNull() & ~F.isnan("number"))
    n = F.col("n1") + F.col("n0") if classes else F.col("n")
    out = rows.groupBy("column", F.col("number").alias("value")).agg(F.sum(n).alias("n"), *([F.sum("n1").alias("n1")] if classes else []))
    return out.where("n > 0")


def source_bytes(df: DataFrame) -> int | None:
    """The estimated bytes of what a frame reads, summed over its sources (estimates of joins would multiply them); None where
    Spark knows nothing of one. Columns that aren't read don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(n >= UNKNOWN for n in sizes) else sum(sizes)


def _cuts(size: int | None) -> int:
    """How often values are cut to ranges: not at all up to BYTES_OF_A_RANGE, then once more for each factor of RANGES; twice for an
    unknown size."""
    if size is None:
        return 2
    n = 0
    while size > BYTES_OF_A_RANGE * RANGES**n and n < 4:
        n += 1
    return n


def ranged(rows: DataFrame, by: str = "column", value: str = "value") -> DataFrame:
    """Adds range: a number that rises with a group's values, cut at approximate quantiles as often as the sources' size asks for."""
    cuts = [i / RANGES for i in range(1, RANGES)]
    out = rows.withColumn("range", F.lit(0).cast("long"))
    for _ in range(_cuts(source_bytes(rows))):
        edges = out.groupBy(by, "range").agg(F.array_distinct(F.percentile_approx(value, cuts, 1000)).alias("edges"))  # RANGES numbers for each
        inner = F.size(F.filter("edges", lambda e: e < F.col(value)))
        out = out.join(F.broadcast(edges), [by, "range"]).withColumn("range", F.col("range") * RANGES + inner).drop("edges")
    return out


def placed(counts: DataFrame, by: str = "column", weights: Sequence[str] = ("n",)) -> DataFrame:
    """Adds before_<w> for each weight: its sum over smaller values of the group.

    The ranges' sums meet (a row for each range), and values are sorted within their range alone."""
    if not _cuts(source_bytes(counts)):
        below = Window.partitionBy(by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(w).over(below), F.lit(0)).alias(f"before_{w}") for w in weights])
    ranged_ = ranged(counts, by)
    totals = ranged_.groupBy(by, "range").agg(*[F.sum(w).alias(f"t_{w}") for w in weights])
    upto = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(by, "range", *[F.coalesce(F.sum(f"t_{w}").over(upto), F.lit(0)).alias(f"o_{w}") for w in weights])
    inside = Window.partitionBy(by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged_.join(F.broadcast(offsets), [by, "range"])
    return out.select(*counts.columns, *[(F.coalesce(F.sum(w).over(inside), F.lit(0)) + F.col(f"o_{w}")).alias(f"before_{w}") for w in weights])


def quantiles(counts: DataFrame, probabilities: Sequence[float], by: str = "column") -> DataFrame:
    """(column, p, q): exact quantiles with linear interpolation, of a frame of value counts."""
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    want = total.select(by, F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"), "total").withColumn("at", (F.col("total") - 1) * F.col("p"))
    here = placed(counts, by).join(F.broadcast(want), by)
    lo = F.floor("at")
    hit = lambda k: (k >= F.col("before_n")) & (k < F.col("before_n") + F.col("n"))
    hi = F.least(lo + 1, F.col("total") - 1)
    got = here.where(hit(lo) | hit(hi)).groupBy(by, "p").agg(F.max(F.when(hit(lo), F.col("value"))).alias("a"), F.max(F.when(hit(hi), F.col("value"))).alias("b"), F.max(F.col("at") - F.floor("at")).alias("f"))
    return got.select(by, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q"))


def average_rank() -> Column:
    """Of a placed value: the mean of the ranks that its copies take, from 1."""
    return F.col("before_n") + (F.col("n") + 1) / 2.0
