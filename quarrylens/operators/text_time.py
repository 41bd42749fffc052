"""Texts and time stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranks

TERM = r"[A-Za-z][A-Za-z0-9_]{2,}"


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean and 95th percentile of length, mean words, blanks."""
    out = []
    for c in columns:
        x = C.name(c)
        out.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(F.length(x)).alias("mean_length"), F.avg(C.words(x)).alias("mean_words"), F.count_if(C.stripped(x) == "").alias("blank_count")))
    lengths = df.select([F.length(C.name(c)).alias(c) for c in columns])
    p95 = ranks.quantiles(ranks.value_counts(lengths, columns), [0.95]).select("column", F.col("q").alias("p95_length"))
    return C.rows_of(df, out).join(F.broadcast(p95), "column", "left")


def top_terms(texts: DataFrame, column: str, order: Column | None = None, first: int | None = 1000, top: int = 20) -> DataFrame:
    """The most frequent terms of the first texts in an order, or of all; ties by term."""
    rows = texts.where(C.name(column).isNotNull())
    if first is not None and order is not None:
        rows = rows.orderBy(order).limit(first)
    terms = rows.select(F.explode(F.regexp_extract_all(F.lower(C.name(column)), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(top)


def _seconds(df: DataFrame, column: str) -> DataFrame:
    """Distinct stamps as (value in microseconds, n); a repeated stamp is n - 1 gaps of zero."""
    micros = F.unix_micros(C.name(column).cast("timestamp"))
    return df.where(C.name(column).isNotNull()).groupBy(micros.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _ranged(rows: DataFrame, column: str) -> DataFrame:
    """Adds range: which part, cut at approximate quantiles, a number is in."""
    return ranks.ranged(rows.withColumn("__k", F.lit(1)), "__k", column).drop("__k")


def time_gaps(df: DataFrame, column: str) -> DataFrame:
    """Median and largest seconds between neighbouring stamps in time order.

    Stamps are cut to ranges at approximate quantiles; gaps are taken within ranges, and between ranges from their ends, so
    that no task sorts all stamps."""
    stamps = _seconds(df, column)
    ranged = _ranged(stamps, "value")
    inside = ranged.select("n", (F.col("value") - F.lag("value").over(Window.partitionBy("range").orderBy("value"))).alias("gap"))
    ends = ranged.groupBy("range").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    between = ends.select((F.col("lo") - F.lag("hi").over(Window.orderBy("range"))).alias("gap"))  # a row for each range
    zero = stamps.where("n > 1").agg(F.sum(F.col("n") - 1).alias("n")).select(F.lit(0.0).alias("value"), "n").where("n > 0")
    gaps = inside.select("gap").unionByName(between).where(F.col("gap").isNotNull()).groupBy((F.col("gap") / 1e6).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = gaps.unionByName(zero).groupBy("value").agg(F.sum("n").alias("n")).withColumn("column", F.lit(column))
    median = ranks.quantiles(counts, [0.5]).select("column", F.col("q").alias("median_gap_seconds"))
    return counts.groupBy("column").agg(F.sum("n").alias("gaps"), F.max("value").alias("largest_gap_seconds")).join(F.broadcast(median), "column")


def frequency(seconds: Column) -> Column:
    """A name for the usual gap; null where it is not positive."""
    return F.when(seconds.isNull() | (seconds <= 0), None).when(seconds <= 60, "sub_hourly").when(seconds <= 3600, "hourly").when(seconds <= 86400, "daily").when(seconds <= 604800, "weekly").otherwise("irregular_or_monthly_plus")


def rises_in_order(df: DataFrame, column: str, order: Column) -> DataFrame:
    """Whether a column never falls in the order of an ordinal. Compared within ranges of the ordinal, and between ranges."""
    rows = df.select(order.cast("long").alias("o"), C.name(column).alias("v")).where(F.col("v").isNotNull())
    ranged = _ranged(rows, "o")
    within = ranged.withColumn("last", F.lag("v").over(Window.partitionBy("range").orderBy("o")))
    parts = within.groupBy("range").agg(F.bool_and(F.coalesce(F.col("v") >= F.col("last"), F.lit(True))).alias("ok"), F.min_by("v", "o").alias("head"), F.max_by("v", "o").alias("tail"))
    joined = parts.select("ok", F.coalesce(F.col("head") >= F.lag("tail").over(Window.orderBy("range")), F.lit(True)).alias("joins"))
    return joined.agg(F.coalesce(F.bool_and(F.col("ok") & F.col("joins")), F.lit(True)).alias("monotonic_increasing")).select(F.lit(column).alias("column"), "monotonic_increasing")
