"""One column at a time: numbers, categories, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranks

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes, adjusted skewness and kurtosis of every column in one scan."""
    out = []
    for c in columns:
        x = C.as_number(df, c)
        out.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), C.skewness(x).alias("skewness"), C.kurtosis(x).alias("kurtosis")))
    return C.rows_of(df, out)


def percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = PERCENTILES) -> DataFrame:
    """(column, p, q), exact."""
    return ranks.quantiles(ranks.value_counts(df, columns), probabilities)


def _spread(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], counts: DataFrame | None = None) -> DataFrame:
    """A row for each column: its percentiles (p01, ...), different values, and values strictly outside of 1.5 quartile ranges and
    of the 1st to 99th percentile. Values are counted and placed once."""
    counts = ranks.value_counts(df, columns) if counts is None else ranks.numbers_of(counts, columns)
    found = ranks.quantiles(counts, sorted({*probabilities, 0.01, 0.25, 0.75, 0.99}))
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(_named(p)) for p in sorted({*probabilities, 0.01, 0.25, 0.75, 0.99})])
    reach, v = 1.5 * (F.col("p75") - F.col("p25")), F.col("value")
    return counts.join(F.broadcast(wide), "column").groupBy("column").agg(  # wide: a row for each column
        *[F.first(_named(p)).alias(_named(p)) for p in probabilities],
        F.sum(F.when((v < F.col("p25") - reach) | (v > F.col("p75") + reach), F.col("n")).otherwise(0)).alias("iqr_outlier_count"),
        F.sum(F.when((v < F.col("p01")) | (v > F.col("p99")), F.col("n")).otherwise(0)).alias("p01_p99_outlier_count"),
        F.count(F.lit(1)).alias("unique_count"),
    )


def _named(p: float) -> str:
    return f"p{round(p * 100):02d}"


def outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values strictly outside of 1.5 quartile ranges and of the 1st to 99th percentile; counted over value counts."""
    return _spread(df, columns, ())


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Everything above on one row per column: one scan for the moments, one for the value counts where no table of them is given."""
    columns = columns or C.numeric_columns(df)
    out = moments(df, columns).join(F.broadcast(_spread(df, columns, PERCENTILES, counts)), "column", "left")
    return out.withColumn("median", F.col("p50"))


def _categories(df: DataFrame, columns: Sequence[str], counts: DataFrame | None) -> DataFrame:
    """(column, value, n, total); null is a value."""
    counts = ranks.value_table(df, columns) if counts is None else counts.where(F.col("column").isin(*columns))
    counts = counts.select("column", C.label(F.col("value")).alias("value"), "n")
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))  # a row for each column
    return counts.groupBy("column", "value").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "column")


def categorical_summary(df: DataFrame, columns: Sequence[str], top: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """(column, value, n, percentage, rank) of each column's most frequent values; ties by value; null is a value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    out = _categories(df, columns, counts).withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("column", "value", "n", C.share(F.col("n"), F.col("total")).alias("percentage"), "rank")


def rare_categories(df: DataFrame, columns: Sequence[str], threshold: float = 0.01, counts: DataFrame | None = None) -> DataFrame:
    """Categories under a share of the rows: how many, their rows and those rows' share."""
    rare = C.share(F.col("n"), F.col("total")) < threshold
    out = _categories(df, columns, counts).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.count_if(rare).alias("rare_category_count"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("rare_row_count"), F.max("total").alias("total"))
    return out.select("column", "unique_count", "rare_category_count", "rare_row_count", C.share(F.col("rare_row_count"), F.col("total")).alias("rare_row_percentage"))


def datetime_summary(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Count, extremes, distinct values and parse failures, of all columns in one scan; fmt reads text columns."""
    pairs = []
    for c in columns:
        t = C.parsed_time(C.name(c), fmt) if fmt else C.name(c)
        pairs.append(F.struct(F.lit(c).alias("column"), t.cast("timestamp_ntz").alias("v"), (C.name(c).isNotNull() & t.isNull()).alias("failed")))
    seen = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    there = F.col("v").isNotNull()
    out = seen.groupBy("column").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(there).alias("unique_count"), F.sum("failed").alias("parse_failure_count"))
    all_ = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(out, "column", "left")
    return all_.select("column", *[F.coalesce(c, F.lit(0)).alias(c) if c not in ("min", "max") else c for c in ("count", "min", "max", "unique_count", "parse_failure_count")])
