"""Two groups of rows held against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Added to both shares of a category, so that no logarithm is of 0.
EPSILON = 1e-6
MOST_NAMES = 10


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group, largest first, ties by name; null is a group."""
    return df.groupBy(C.label(C.name(group)).alias("group")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group")


def chosen_groups(groups: Sequence[str]) -> tuple[str, str] | None:
    """Reference and current: train and test, else reference and current, else the two largest."""
    for pair in (("train", "test"), ("reference", "current")):
        by_lower = {g.lower(): g for g in reversed(groups)}
        if all(p in by_lower for p in pair):
            return by_lower[pair[0]], by_lower[pair[1]]
    return (groups[0], groups[1]) if len(groups) > 1 else None


def _sides(df: DataFrame, group: str, reference: str, current: str) -> tuple[DataFrame, Column, Column]:
    """The rows of both groups, and whether a row is of the one or the other."""
    g = C.label(C.name(group))
    return df.where(g.isin(reference, current)), g == reference, g == current


def standardised_differences(df: DataFrame, group: str, reference: str, current: str, columns: Sequence[str]) -> DataFrame:
    """(mean of reference - mean of current) / root of the mean variance; null under 2 rows a side or without spread."""
    rows, ref, cur = _sides(df, group, reference, current)
    out = []
    for c in columns:
        x = C.as_number(df, c)
        side = {k: F.when(m, x) for k, m in (("r", ref), ("c", cur))}
        out.append(F.struct(F.lit(c).alias("column"), *[f(side[k]).alias(f"{n}{k}") for k in side for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]))
    pooled = F.sqrt((F.col("vr") + F.col("vc")) / 2.0)
    fit = (F.col("nr") >= 2) & (F.col("nc") >= 2) & (pooled > 0)
    return C.rows_of(rows, out).select("column", F.when(fit, F.try_divide(F.col("mr") - F.col("mc"), pooled)).alias("smd"))


def category_shares(df: DataFrame, group: str, reference: str, current: str, columns: Sequence[str]) -> DataFrame:
    """(column, category, n_ref, n_cur) in one pass; null is a category."""
    rows, ref, cur = _sides(df, group, reference, current)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.label(C.name(c)).alias("category")) for c in columns])
    long = rows.select(ref.alias("ref"), cur.alias("cur"), F.explode(pairs).alias("p")).select("ref", "cur", "p.*")
    return long.groupBy("column", "category").agg(F.count_if("ref").alias("n_ref"), F.count_if("cur").alias("n_cur"))


def population_stability(df: DataFrame, group: str, reference: str, current: str, columns: Sequence[str]) -> DataFrame:
    counts = category_shares(df, group, reference, current, columns)
    totals = counts.groupBy("column").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    e, a = C.share(F.col("n_ref"), F.col("t_ref")) + EPSILON, C.share(F.col("n_cur"), F.col("t_cur")) + EPSILON
    return counts.join(F.broadcast(totals), "column").groupBy("column").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def status(value: Column, warn: float = 0.2, fail: float = 0.5) -> Column:
    return F.when(F.abs(value) >= fail, "fail").when(F.abs(value) >= warn, "warn").otherwise("pass")


def drift(df: DataFrame, group: str, reference: str, current: str, numbers: Sequence[str], categories: Sequence[str], warn: float = 0.2, fail: float = 0.5, top: int = 25) -> DataFrame:
    """The most shifted columns: metric, value, status."""
    smd = standardised_differences(df, group, reference, current, numbers).select("column", F.lit("standardized_mean_difference").alias("metric"), F.col("smd").alias("value")) if numbers else None
    psi = population_stability(df, group, reference, current, categories).select("column", F.lit("population_stability_index").alias("metric"), F.col("psi").alias("value")) if categories else None
    both = smd.unionByName(psi) if smd is not None and psi is not None else smd if smd is not None else psi
    return both.where(F.col("value").isNotNull()).withColumn("status", status(F.col("value"), warn, fail)).orderBy(F.desc(F.abs("value")), "column").limit(top)


def comparison(df: DataFrame, group: str, reference: str, current: str, numbers: Sequence[str]) -> DataFrame:
    """Missing shares and means of both groups, their deltas and the change score (the mean's, else the missing share's)."""
    rows, ref, cur = _sides(df, group, reference, current)
    out = []
    for c in numbers:
        x = C.as_number(df, c)
        gone = lambda m: F.avg(F.when(m, x.isNull().cast("double")))  # noqa: E731, B023
        out.append(F.struct(F.lit(c).alias("column"), gone(ref).alias("reference_missing"), gone(cur).alias("current_missing"), F.avg(F.when(ref, x)).alias("reference_mean"), F.avg(F.when(cur, x)).alias("current_mean")))
    gap, mean = F.col("current_missing") - F.col("reference_missing"), F.col("current_mean") - F.col("reference_mean")
    return C.rows_of(rows, out).select("*", gap.alias("missing_delta"), mean.alias("mean_delta"), F.coalesce(mean, gap).alias("change_score"))


def category_changes(df: DataFrame, group: str, reference: str, current: str, columns: Sequence[str], most: int = MOST_NAMES) -> DataFrame:
    """Categories that only one group has (nulls aside): how many, the first in order, and the change score, which is made of
    the capped list and the missing share's delta."""
    counts = category_shares(df, group, reference, current, columns)
    real = F.col("category") != C.MISSING
    new, old = real & (F.col("n_ref") == 0) & (F.col("n_cur") > 0), real & (F.col("n_cur") == 0) & (F.col("n_ref") > 0)
    gone = F.col("category") == C.MISSING
    out = counts.groupBy("column").agg(
        F.count_if(real & (F.col("n_ref") > 0)).alias("reference_unique"), F.count_if(real & (F.col("n_cur") > 0)).alias("current_unique"), F.count_if(new).alias("new_count"), F.count_if(old).alias("removed_count"),
        (C.share(F.sum(F.when(gone, F.col("n_cur")).otherwise(0)), F.sum("n_cur")) - C.share(F.sum(F.when(gone, F.col("n_ref")).otherwise(0)), F.sum("n_ref"))).alias("missing_delta"),
    )
    # the lists are cut by rank, in each task and then over all, before they are gathered
    named = counts.where(new | old).select("column", new.alias("is_new"), "category")
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("column", "is_new").orderBy("category"))).where(F.col("nth") <= most)
    of = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("category"))))
    named = named.groupBy("column").agg(of(F.col("is_new")).alias("new_values"), of(~F.col("is_new")).alias("removed_values"))
    none = F.array().cast("array<string>")
    out = out.join(F.broadcast(named), "column", "left").withColumn("new_values", F.coalesce("new_values", none)).withColumn("removed_values", F.coalesce("removed_values", none))  # a row for each column
    score = F.greatest(F.abs("missing_delta"), F.coalesce(C.share(F.size("new_values"), F.col("current_unique")), F.lit(0.0)))
    return out.withColumn("change_score", score)
