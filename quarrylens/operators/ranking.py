"""Evidence kept as frames: joins of it by column, ranking, de-duplication, gates, comparison of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ProfileConfig
from . import missingness, typing


def severity_order(severity: F.Column) -> F.Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def most_severe(findings: DataFrame, key: str, severity: str, position: str) -> DataFrame:
    """Of each key the most severe finding, the first of equals."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(severity_order(F.col(severity)), position))
    return findings.withColumn("__first", first).where(F.col("__first") == 1).drop("__first")


def quality_flags(df: DataFrame, config: ProfileConfig | None = None) -> DataFrame:
    """(column, issue_type, severity, metric_value): what the counts of each column alone tell."""
    config = config or ProfileConfig()
    kinds = typing.semantic_types(df, config.near_constant_threshold, config.high_cardinality_threshold)
    facts = missingness.column_missingness(df).join(F.broadcast(kinds.drop("non_null_count")), "column")  # a row for each column
    k, gone, m = F.col("semantic_type"), F.col("missing_percentage"), lambda c: F.col(c).cast("double")
    rules = (
        (k == "all_missing", "all_missing", "high", F.lit(0.0)),
        ((k != "all_missing") & (gone >= config.high_missingness_threshold), "high_missingness", "medium", gone),
        (k == "constant", "constant_column", "medium", m("unique_count")),
        (k == "near_constant", "near_constant_column", "low", m("top_frequency_ratio")),
        (k == "categorical_high_cardinality", "high_cardinality", "medium", m("unique_count")),
        ((F.col("unique_ratio") >= 0.95) & (F.col("non_null_count") + F.col("missing_count") >= 20), "id_like_candidate", "low", m("unique_ratio")),
        (F.col("blank_string_count") > 0, "blank_strings", "low", m("blank_string_count")),
    )
    found = F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(i).alias("issue_type"), F.lit(s).alias("severity"), v.alias("metric_value"))) for on, i, s, v in rules])
    return facts.select("column", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("column", "f.*")


def ranked_features(features: DataFrame) -> DataFrame:
    """Adds rank to (column, signal_score, quality_penalty, has_leakage, position): leakage first, then score, then penalty."""
    w = Window.orderBy(F.desc("has_leakage"), F.desc(F.coalesce("signal_score", F.lit(-1.0))), "quality_penalty", "position")  # a row for each column
    return features.withColumn("rank", F.row_number().over(w))


def leakage_flags(relations: DataFrame, names: DataFrame, high_auc: float = 0.98, separation: float = 0.95) -> DataFrame:
    """(column, issue_type, severity, metric_value) of what may give a response away: relations has column, auc_abs and
    response_rate_spread, of which the spread counts only where the AUC doesn't; names has column and suspicious."""
    auc, spread = F.col("auc_abs"), F.col("response_rate_spread")
    reason = F.when(auc >= high_auc, "high_auc").when(spread >= separation, "near_perfect_separation")
    found = relations.select("column", reason.alias("issue_type"), F.lit("high").alias("severity"), F.when(auc >= high_auc, auc).otherwise(spread).alias("metric_value"))
    named = names.where("suspicious").select("column", F.lit("suspicious_name").alias("issue_type"), F.lit("medium").alias("severity"), F.lit(1.0).alias("metric_value"))
    return found.where(F.col("issue_type").isNotNull()).unionByName(named)


def ranking_of_evidence(columns: DataFrame, missing: DataFrame, relations: DataFrame, quality: DataFrame, leakage: DataFrame) -> DataFrame:
    """The ranking from five frames joined by column: (column, position), (column, missing_percentage), (column, signal_score), and two of
    findings with a severity. The findings of a column are added up to its penalty, 1 at most."""
    weight = F.when(F.col("severity") == "high", 0.5).when(F.col("severity") == "medium", 0.25).otherwise(0.1)
    sums = lambda df, n: df.groupBy("column").agg(F.sum(weight).alias(f"{n}_weight"), F.array_sort(F.collect_list("issue_type")).alias(f"{n}_issues"))
    out = columns.join(missing, "column", "left").join(relations, "column", "left").join(sums(quality, "quality"), "column", "left").join(sums(leakage, "leakage"), "column", "left")
    zero, none = F.lit(0.0), F.array().cast("array<string>")
    penalty = F.least(F.lit(1.0), F.coalesce("quality_weight", zero) + F.coalesce("leakage_weight", zero))
    rows = out.select("column", "position", "missing_percentage", "signal_score", penalty.alias("quality_penalty"), F.col("leakage_issues").isNotNull().alias("has_leakage"), F.coalesce("quality_issues", none).alias("data_quality_warnings"), F.coalesce("leakage_issues", none).alias("leakage_warnings"))
    return ranked_features(rows)


def gate(checks: DataFrame) -> DataFrame:
    """Counts of the statuses and the worst of them."""
    n = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "not_applicable")}
    out = checks.agg(*n.values(), F.count(F.lit(1)).alias("total"))
    return out.withColumn("overall_status", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("pass"))


def rank_changes(left: DataFrame, right: DataFrame, top: int = 20) -> DataFrame:
    """(column, left_rank, right_rank, change) of the columns in either ranking's top."""
    a = left.where(F.col("rank") <= top).select("column", F.col("rank").alias("left_rank"))
    b = right.where(F.col("rank") <= top).select("column", F.col("rank").alias("right_rank"))
    change = F.when(F.col("left_rank").isNull(), "new").when(F.col("right_rank").isNull(), "removed").when(F.col("left_rank") == F.col("right_rank"), "same").otherwise("moved")
    return a.join(b, "column", "full_outer").select("column", F.coalesce("left_rank", F.lit(0)).alias("left_rank"), F.coalesce("right_rank", F.lit(0)).alias("right_rank"), change.alias("change"))
