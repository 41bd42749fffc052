"""Rules as rows: evidence in one long frame, limits in a small one, and the range join of both.

Evidence has (source, column, related, metric, value); a rule is broken where its source and metric are an evidence's and the value
lies in [low, high). Findings, risks and gate checks are made of such joins. The rules are a fixed few dozen rows, so they
are broadcast; evidence has some rows for each column or pair of columns of a table, whatever its rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..functions import columns as C
from . import missingness, ranking, typing

INF = float("inf")
EVIDENCE = ("source", "column", "related", "metric", "value")


@dataclass(frozen=True)
class Rule:
    """label is an issue or the beginning of a risk's id, parts are what follows in that id; category is the risk's, label if not given."""

    source: str
    metric: str
    low: float
    high: float
    label: str
    severity: str
    parts: tuple[str, ...] = ("column",)
    category: str = ""


def quality_rules(config: ProfileConfig) -> list[Rule]:
    """Of single columns and of the table. Which evidence there is of a column depends on its type (see column_evidence)."""
    c, at_least = config, lambda metric, low, label, severity: Rule("columns", metric, low, INF, label, severity)
    return [
        at_least("duplicate_row_count", 1, "duplicate_rows", "medium"), at_least("duplicate_id_count", 1, "duplicate_id_values", "high"), at_least("collision", 2, "normalized_name_collision", "medium"),
        at_least("numeric_parse_rate", typing.NUMBER_RATE, "numeric_parse_candidate", "low"), at_least("datetime_parse_rate", typing.DATE_RATE, "datetime_parse_candidate", "low"), at_least("boolean_parse_rate", 1, "boolean_parse_candidate", "low"),
        Rule("columns", "non_null_count", 0, 1, "all_missing", "high"), at_least("missing_percentage", c.high_missingness_threshold, "high_missingness", "medium"),
        Rule("columns", "unique_count", 1, 2, "constant_column", "medium"), at_least("top_frequency_ratio", c.near_constant_threshold, "near_constant_column", "low"), at_least("category_count", c.high_cardinality_threshold + 1, "high_cardinality", "medium"),
        at_least("unique_ratio", 0.95, "id_like_candidate", "low"), at_least("suspicious_name", 1, "suspicious_column_name", "medium"),
        at_least("blank_string_count", 1, "blank_strings", "low"), at_least("special_missing_code_count", 1, "special_missing_codes", "low"),
    ]


#: What a quality issue puts at risk.
RISK_OF_ISSUE = {
    "cardinality": ("high_cardinality",), "identifier": ("id_like_candidate",), "missingness": ("high_missingness", "all_missing"), "sparsity": ("near_constant_column", "constant_column"),
    "schema": ("normalized_name_collision", "numeric_parse_candidate", "datetime_parse_candidate", "boolean_parse_candidate"),
}


def risk_rules(config: ProfileConfig) -> list[Rule]:
    """Beside leakage and quality, whose risks come from their findings: of types, missing values by response, pairs of columns,
    shifts, the response, and the ranking."""
    c, shifts = config, ("standardized_mean_difference", "population_stability_index")
    return [
        Rule("columns", "category_count", c.high_cardinality_threshold + 1, INF, "cardinality", "medium"), Rule("columns", "unique_count", 1, 2, "sparsity", "medium"), Rule("columns", "top_frequency_ratio", c.near_constant_threshold, INF, "sparsity", "low"),
        Rule("missing_by_response", "response_rate_gap", 0.20, INF, "missingness_response", "medium", category="missingness"),
        Rule("pairs", "abs_correlation", c.high_correlation_threshold, INF, "correlation", "medium", ("column", "related")), Rule("pairs", "duplicate_column_pair", 1, INF, "duplicate_column", "medium", ("column", "related")),
        *[Rule("drift", m, c.drift_warning_threshold, c.drift_fail_threshold, "drift", "medium", ("column", "metric")) for m in shifts], *[Rule("drift", m, c.drift_fail_threshold, INF, "drift", "high", ("column", "metric")) for m in shifts],
        Rule("response", "imbalance_ratio", 10, INF, "response.severe_class_imbalance", "high", (), "response"), Rule("response", "missing_response_count", 1, INF, "response.missing_response_values", "high", (), "response"),
        Rule("response", "skewness_size", 2, INF, "response.skewed_regression_response", "medium", (), "response"), Rule("ranking", "quality_penalty", 0.5, INF, "ranked_feature_quality", "medium"),
    ]


def regression_rules() -> list[Rule]:
    """Of a numeric response."""
    at_least = lambda metric, low, label, severity: Rule("regression", metric, low, INF, label, severity)
    return [
        at_least("missing_response_count", 1, "missing_response_values", "high"), at_least("parse_failure_count", 1, "unparseable_regression_response_values", "medium"), at_least("numeric_parse_rate", typing.NUMBER_RATE, "numeric_string_response_inferred_as_regression", "medium"),
        Rule("regression", "count", 0, 3, "unusable_regression_response", "high"), at_least("zero_variance", 1, "zero_variance_regression_response", "high"), at_least("iqr_outlier_count", 1, "regression_response_outliers", "medium"), at_least("skewness_size", 2, "skewed_regression_response", "medium"),
    ]


def regression_evidence(target: DataFrame, response: str, text: bool) -> DataFrame:
    """Of response.regression_target(). A text's parse rate counts, that of a number doesn't; of fewer than three numbers nothing
    else of their spread is told."""
    n, d = F.col("count"), lambda c: c.cast("double")
    given = {
        "missing_response_count": F.col("missing_count") - F.col("parse_failure_count"), "parse_failure_count": F.col("parse_failure_count"), "numeric_parse_rate": C.share(n, n + F.col("parse_failure_count")) if text else F.lit(None),
        "count": n, "zero_variance": F.when(n >= 3, F.col("zero_variance").cast("int")), "iqr_outlier_count": F.when(n >= 3, F.col("iqr_outlier_count")), "skewness_size": F.when(n >= 3, F.abs("skewness")),
    }
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), d(v).alias("value")) for m, v in given.items()]))
    return evidence(target.select(long.alias("e")), "regression", F.col("e.metric"), "e.value", F.lit(response)).where(F.col("value").isNotNull())


def named(name: Column) -> Column:
    """A name as a part of an id."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^0-9a-z]+", "_"), F.lit("_")), F.lit("")), F.lit("dataset"))


def evidence(df: DataFrame, source: str, metric: str | Column, value: str | Column, column: str | Column = "column", related: str | Column | None = None) -> DataFrame:
    """One metric of a frame as evidence; a metric's name may be a column."""
    metric = F.lit(metric) if isinstance(metric, str) else metric
    as_column = lambda x: F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(source).alias("source"), as_column(column).cast("string").alias("column"), as_column(related).cast("string").alias("related"), metric.alias("metric"), as_column(value).cast("double").alias("value"))


def column_evidence(df: DataFrame, config: ProfileConfig, suspicious: Sequence[str] = (), collisions: Sequence[int] = (), counts: DataFrame | None = None) -> DataFrame:
    """What the rules on single columns and on the table look at, from types, missing values, codes, parse rates, ids and rows. All but
    first texts and equal rows are made of a value table, if one is given.

    A type's metrics are given only where they count: missing shares of columns with values, the top value's share where there are
    two or more, categories where the type is one of many categories, unique shares of 20 rows and more that are no ids."""
    spark, texts = df.sparkSession, C.text_columns(df)
    kinds = typing.semantic_types(df, config.near_constant_threshold, config.high_cardinality_threshold, counts=counts)
    facts = missingness.column_missingness(df, counts=counts).join(F.broadcast(kinds.drop("non_null_count")), "column")  # a row for each column
    codes = missingness.special_missing_codes(df, counts=counts).groupBy("column").agg(F.sum("n").alias("codes"))
    facts = facts.join(F.broadcast(codes), "column", "left")
    k, n, gone = F.col("semantic_type"), F.col("non_null_count"), F.col("missing_count")
    given = {
        "non_null_count": n, "missing_percentage": F.when(n > 0, F.col("missing_percentage")), "unique_count": F.col("unique_count"), "top_frequency_ratio": F.when(F.col("unique_count") > 1, F.col("top_frequency_ratio")),
        "category_count": F.when(k == "categorical_high_cardinality", F.col("unique_count")), "unique_ratio": F.when((n + gone >= 20) & ~F.col("column").isin(*config.id_columns, ""), F.col("unique_ratio")),
        "blank_string_count": F.col("blank_string_count"), "special_missing_code_count": F.col("codes"),
    }
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in given.items()]))
    out = evidence(facts.select("column", long.alias("e")), "columns", F.col("e.metric"), "e.value")
    out = out.unionByName(evidence(missingness.duplicate_rows(df), "columns", "duplicate_row_count", "duplicate_rows", column=None))
    if config.id_columns:
        out = out.unionByName(evidence(missingness.duplicate_ids(df, config.id_columns, counts), "columns", "duplicate_id_count", "duplicate_values"))
    if texts:
        rates = typing.parse_rates(df, texts, counts).join(F.broadcast(kinds.select("column", "semantic_type")), "column")
        typed = k.isin("boolean", "all_missing")
        for m, on in (("numeric_parse_rate", ~typed), ("datetime_parse_rate", F.lit(True)), ("boolean_parse_rate", ~typed)):
            out = out.unionByName(evidence(rates.where(on), "columns", m, m))
    told = [(c, "suspicious_name", 1.0) for c in suspicious] + [(None, "collision", float(x)) for x in collisions]
    return out.unionByName(evidence(spark.createDataFrame(told, "column string, m string, value double"), "columns", F.col("m"), "value")).where(F.col("value").isNotNull())


def kept(small: DataFrame) -> DataFrame:
    """A frame of some rows for each column, or for each pair over a limit, taken once: what is made of it doesn't read the table again."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def applied(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Evidence with the rules that it breaks: label, severity, parts and the limit."""
    spark: SparkSession = found.sparkSession
    rows = [(r.source, r.metric, float(r.low), float(r.high), r.label, r.severity, list(r.parts), r.category or r.label) for r in rules]
    table = spark.createDataFrame(rows, "rule_source string, rule_metric string, low double, high double, label string, severity string, parts array<string>, category string")
    on = (F.col("source") == F.col("rule_source")) & (F.col("metric") == F.col("rule_metric")) & (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high"))
    return found.join(F.broadcast(table), on).select(*EVIDENCE, "label", "severity", "parts", "category", F.col("low").alias("threshold"))  # a row for each rule


def findings(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(warning_id, column, issue_type, severity, metric_name, metric_value, threshold) of the quality rules."""
    at = F.coalesce("column", F.lit("dataset"))
    return applied(found, rules).select(
        F.concat_ws(".", "label", named(at)).alias("warning_id"), "column", F.col("label").alias("issue_type"), "severity", F.col("metric").alias("metric_name"), F.col("value").alias("metric_value"), "threshold"
    )


_RISK = ("risk_id", "category", "severity", "column", "related_column", "metric_name", "metric_value")


def risks(found: DataFrame, quality: DataFrame, leakage: DataFrame, config: ProfileConfig) -> DataFrame:
    """(risk_id, category, severity, column, related_column, metric_name, metric_value): of each id the most severe. found is the
    evidence, quality is of findings(), and leakage has column, issue_type, severity and metric_value. Types of columns that are no
    candidate predictors are no risk."""
    none = F.lit(None).cast("string")
    category = F.coalesce(*[F.when(F.col("issue_type").isin(*issues), c) for c, issues in RISK_OF_ISSUE.items()])
    leaks = leakage.select(F.concat_ws(".", F.lit("leakage"), "column", named(F.col("issue_type"))).alias("risk_id"), F.lit("leakage").alias("category"), "severity", "column", none.alias("related_column"), F.col("issue_type").alias("metric_name"), "metric_value")
    faults = quality.withColumn("category", category).where(F.col("category").isNotNull())
    faults = faults.select(F.concat_ws(".", "category", "warning_id").alias("risk_id"), "category", "severity", "column", none.alias("related_column"), "metric_name", "metric_value")
    part = lambda p: F.when(F.array_contains("parts", p), named(F.col(p)))
    others = applied(found.where((F.col("source") != "columns") | ~F.col("column").isin(*config.excluded(), "")), risk_rules(config))
    others = others.select(F.concat_ws(".", "label", part("column"), part("related"), part("metric")).alias("risk_id"), "category", "severity", "column", F.col("related").alias("related_column"), F.col("metric").alias("metric_name"), F.col("value").alias("metric_value"))
    every = leaks.unionByName(faults).unionByName(others)
    at = F.struct("category", F.coalesce("metric_name", F.lit("")), F.coalesce("metric_value", F.lit(0.0)))
    return ranking.most_severe(every.withColumn("at", at), "risk_id", "severity", "at").select(*_RISK)


#: Parts of the gate that say so where they find nothing.
QUIET = {"missingness": "missingness.high_columns", "correlation": "correlation.high_pairs", "drift": "drift.thresholds", "modeling_risk": "modeling_risk.review_queue"}


def checks(found: DataFrame, quality: DataFrame, leakage: DataFrame, at_risk: DataFrame, config: ProfileConfig, compared: bool, ignored_groups: int = 0) -> DataFrame:
    """(part, check_id, status) of every part of the gate over findings, evidence and risks. High severities fail, others warn; a
    part without any finding passes; without two groups to compare drift is not applicable."""
    spark = found.sparkSession
    status = F.when(F.col("severity") == "high", "fail").otherwise("warn")
    row = lambda df, part, check_id, state=status: df.select(F.lit(part).alias("part"), check_id.alias("check_id"), state.alias("status"))
    name = lambda *parts: F.concat_ws(".", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    of = lambda source, metric=None: found.where((F.col("source") == source) & (F.col("metric") == metric if metric else F.lit(True)))
    column, value = F.col("column"), F.col("value")
    broken = applied(found, risk_rules(config))
    issue = F.substring_index("label", ".", -1)
    out = [
        row(quality, "quality", name("quality", F.col("warning_id"), F.coalesce("column", F.lit("dataset")))),
        row(leakage, "leakage", name("leakage", column)),
        row(of("columns", "missing_percentage").unionByName(of("columns", "non_null_count").where("value = 0").withColumn("value", F.lit(1.0))).where(value >= config.high_missingness_threshold), "missingness", name("missingness.high", column), F.when(value >= 0.95, "fail").otherwise("warn")),
        row(broken.where("metric = 'abs_correlation'"), "correlation", name("correlation.high", column, F.col("related"))),
        row(broken.where("source = 'drift'"), "drift", name("drift", F.col("metric"), column)),
        row(broken.where("source = 'response'"), "response", name("response", issue, named(column))),
        row(of("response", "positive_class"), "response", name("response.positive_class_auto_selected", named(column)), F.lit("pass")),
        row(at_risk, "modeling_risk", name("modeling_risk", F.col("risk_id"))),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    fixed = [("dataset", "dataset.non_empty", "pass")] + ([("ignored", "drift.ignored_groups", "warn")] if ignored_groups else [])
    fixed += [] if compared else [("drift", "drift.available", "not_applicable")]
    every = every.unionByName(spark.createDataFrame(fixed, "part string, check_id string, status string"))
    quiet = spark.createDataFrame([(p, c, "pass") for p, c in QUIET.items()], "part string, check_id string, status string")
    return every.unionByName(quiet.join(every.select("part").distinct(), "part", "left_anti"))
