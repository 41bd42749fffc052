"""The queries over the test tables, one for each operator, with the SQL that gives the same rows.

Every query runs over its whole table. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..functions import columns as C
from ..functions import ranks, special
from ..operators import bivariate, drift, missingness, ranking, response, rulebook, text_time, typing, univariate
from . import rules
from .views import V1_SQL, V2_SQL, V3_SQL, V4_SQL, V5_SQL, V6_SQL, V7_SQL, V8_SQL, V9_SQL, V10_SQL, V11_SQL, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def registered(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: C.rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def _each(template: str, names, sep: str = "\nUNION ALL\n") -> str:
    return sep.join(template.replace("{c}", n) for n in names)


V1_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# counts, duplicates, missing values


@query("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def overview_shape(spark, sf):
    return missingness.shape(table(spark, sf, "lineitem"))


_ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"""WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY {_ALL})
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_percentage FROM g""")
def duplicate_rows(spark, sf):
    return missingness.duplicate_rows(table(spark, sf, "lineitem"))


@query(_each("SELECT '{c}' AS \"column\", count(*) - count(DISTINCT {c}) AS duplicate_values, count(DISTINCT {c}) AS distinct_values FROM orders", ["o_orderkey", "o_custkey"]))
def duplicate_ids(spark, sf):
    return missingness.duplicate_ids(table(spark, sf, "orders"), ["o_orderkey", "o_custkey"])


_MISSING = """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count({c}) AS non_null_count, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_percentage, CAST(0 AS BIGINT) AS blank_string_count FROM v"""


@query(f"WITH v AS ({V1_SQL})\n" + _each(_MISSING, V1_COLUMNS))
def column_missingness(spark, sf):
    return missingness.column_missingness(view(spark, sf, V1_SQL), V1_COLUMNS).drop("zero_count")


@query(f"WITH v AS ({V1_SQL})\n" + "SELECT * FROM (" + _each("SELECT '{c}' AS \"column\", round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS missing_percentage FROM v", V1_COLUMNS) + ") WHERE missing_percentage >= 0.4")
def high_missingness(spark, sf):
    return missingness.high_missingness(view(spark, sf, V1_SQL).select(*V1_COLUMNS))


@query(f"""WITH v AS ({V1_SQL}), m AS (SELECT {" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in V1_COLUMNS)} AS m FROM v)
SELECT round(avg(m), 6) AS mean_missing_columns, CAST(max(m) AS BIGINT) AS max_missing_columns, count(*) FILTER (WHERE m >= 2) AS rows_half_missing FROM m""")
def row_missingness(spark, sf):
    return missingness.row_missingness(view(spark, sf, V1_SQL), V1_COLUMNS)


_GONE = ["l_discount", "l_tax", "l_returnflag"]
_PAIRS = [(a, b) for i, a in enumerate(_GONE) for b in _GONE[i + 1 :]]


@query(f"WITH v AS ({V1_SQL})\n" + "\nUNION ALL\n".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER)), 6) AS correlation FROM v" for a, b in _PAIRS))
def missing_flag_corr(spark, sf):
    return missingness.missing_flag_correlation(view(spark, sf, V1_SQL), _GONE)


@query(f"""WITH v AS ({V2_SQL}), c AS (
  SELECT 'c_mktsegment' AS "column", lower(trim(c_mktsegment)) AS code FROM v WHERE lower(trim(c_mktsegment)) IN {missingness.MISSING_TEXTS}
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM v WHERE c_nationkey IN {missingness.MISSING_NUMBERS})
SELECT "column", code, count(*) AS n FROM c GROUP BY ALL""")
def special_missing_codes(spark, sf):
    return missingness.special_missing_codes(view(spark, sf, V2_SQL), ["c_mktsegment", "c_nationkey"])


@query(f"WITH v AS ({V2_SQL})\n" + _each("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE trim({c}) = '') AS blank_string_count FROM v", ["c_name", "c_mktsegment"]))
def blank_strings(spark, sf):
    return missingness.column_missingness(view(spark, sf, V2_SQL), ["c_name", "c_mktsegment"]).select("column", "blank_string_count")


@query(_each("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS zero_count FROM lineitem", NUMBERS))
def zero_counts(spark, sf):
    return missingness.column_missingness(table(spark, sf, "lineitem"), NUMBERS).select("column", "zero_count")


_Y = "CASE WHEN l_linestatus = 'O' THEN 1e0 WHEN l_linestatus = 'F' THEN 0e0 END"


def _y() -> F.Column:
    return response.encoded(F.col("l_linestatus"), "O", "F")


@query(f"WITH v AS (SELECT *, {_Y} AS y FROM ({V1_SQL}))\n" + _each("""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, round(avg(y) FILTER (WHERE {c} IS NULL), 6) AS response_rate_missing,
  round(avg(y) FILTER (WHERE {c} IS NOT NULL), 6) AS response_rate_present, round(avg(y) FILTER (WHERE {c} IS NULL) - avg(y) FILTER (WHERE {c} IS NOT NULL), 6) AS response_rate_gap FROM v""", V1_COLUMNS))
def missing_by_response(spark, sf):
    return missingness.missing_by_response(view(spark, sf, V1_SQL), _y(), V1_COLUMNS)


@query(f"WITH v AS (SELECT *, coalesce(l_returnflag, '<MISSING>') AS s FROM ({V1_SQL}))\n" + _each("SELECT s AS segment_value, '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing_percentage FROM v GROUP BY s", ["l_discount", "l_tax"]))
def missing_by_segment(spark, sf):
    return missingness.missing_by_segment(view(spark, sf, V1_SQL), "l_returnflag", ["l_discount", "l_tax"])


# types


_TYPED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}


@query("\nUNION ALL\n".join(_each(f"SELECT '{{c}}' AS \"column\", count(DISTINCT {{c}}) AS unique_count, round(count(DISTINCT {{c}}) / CAST(count({{c}}) AS DOUBLE), 6) AS unique_ratio FROM {t}", cs) for t, cs in _TYPED.items()))
def column_cardinality(spark, sf):
    a, b = (typing.cardinality(table(spark, sf, t), cs) for t, cs in _TYPED.items())
    return a.unionByName(b).select("column", "unique_count", "unique_ratio")


@query("\nUNION ALL\n".join(_each(f"SELECT '{{c}}' AS \"column\", round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_frequency_ratio FROM (SELECT count(*) AS n FROM {t} WHERE {{c}} IS NOT NULL GROUP BY {{c}})", cs) for t, cs in _TYPED.items()))
def top_frequency(spark, sf):
    a, b = (typing.cardinality(table(spark, sf, t), cs) for t, cs in _TYPED.items())
    return a.unionByName(b).select("column", "top_frequency_ratio")


_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]


def _semantic(c: str) -> str:
    number, text, stamp = c not in ("l_returnflag", "l_linestatus", "l_shipdate"), c in ("l_returnflag", "l_linestatus"), c == "l_shipdate"
    integral = f"bool_and(abs(v - round(v)) <= 1e-8)" if number else "false"
    return f"""SELECT '{c}' AS "column", CASE WHEN count(*) = 0 THEN 'all_missing' WHEN count(*) = 1 THEN 'constant' WHEN max(n) / CAST(sum(n) AS DOUBLE) >= 0.98 THEN 'near_constant'
  WHEN {stamp} THEN 'datetime' WHEN count(*) <= 2 AND bool_and(lower(s) IN ('true','false','t','f','yes','no','y','n','0','1')) THEN 'boolean' WHEN count(*) = 2 THEN 'binary'
  WHEN {number} AND count(*) <= 20 AND {integral} THEN 'numeric_discrete' WHEN {number} THEN 'numeric_continuous'
  WHEN {text} AND count(*) > 50 THEN 'categorical_high_cardinality' ELSE 'categorical_low_cardinality' END AS semantic_type
FROM (SELECT {c} AS v, CAST({c} AS VARCHAR) AS s, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})"""


@query("\nUNION ALL\n".join(_semantic(c) for c in _LINE))
def semantic_types(spark, sf):
    return typing.semantic_types(table(spark, sf, "lineitem").select(*_LINE)).select("column", "semantic_type")


@query(f"""WITH v AS ({V2_SQL})
""" + _each(r"""SELECT '{c}' AS "column", round(avg(CAST(regexp_matches(trim({c}), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') AS INTEGER)), 6) AS numeric_parse_rate,
  round(avg(CAST(lower(trim({c})) IN ('true','false','t','f','yes','no','y','n','0','1') AS INTEGER)), 6) AS boolean_parse_rate FROM v WHERE trim({c}) <> ''""", ["balance_text", "c_mktsegment", "c_name"]))
def parse_rates(spark, sf):
    return typing.parse_rates(view(spark, sf, V2_SQL), ["balance_text", "c_mktsegment", "c_name"]).select("column", "numeric_parse_rate", "boolean_parse_rate")


@query(r"""WITH s AS (SELECT text, lang FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 500)
SELECT 'text' AS "column", round(avg(length(text)), 6) AS mean_length, round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))), 6) AS mean_words, true AS text_like FROM s
UNION ALL SELECT 'lang', round(avg(length(lang)), 6), round(avg(len(list_filter(regexp_split_to_array(lang, '\s+'), lambda x: x <> ''))), 6), false FROM s""")
def text_like(spark, sf):
    """The first 500 values in order of id, which is what the operator looks at."""
    return typing.text_like(table(spark, sf, "documents"), ["text", "lang"], F.col("doc_id"))


@query("\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", {'true' if c.endswith('_id') else "(count(DISTINCT " + c + ") / CAST(count(" + c + ") AS DOUBLE) >= 0.95 AND count(*) >= 20 AND count(DISTINCT " + c + ") >= greatest(20, 0.8 * count(*)))"} AS id_like FROM orders""" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")))
def id_like(spark, sf):
    return typing.id_like(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


# one column


_PCT = univariate.PERCENTILES
_MOMENTS = """count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis"""
_QUANT = ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS p{round(p * 100):02d}" for p in _PCT) + ", round(quantile_cont({c}, 0.5), 6) AS median"
_OUT = """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outlier_count, count(*) FILTER (WHERE {c} < p01 OR {c} > p99) AS p01_p99_outlier_count
FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99 FROM {t})"""


@query("SELECT * FROM (" + _each(f"SELECT '{{c}}' AS \"column\", {_MOMENTS}, {_QUANT} FROM lineitem", NUMBERS) + ") JOIN (" + _each(_OUT.replace("{t}", "lineitem"), NUMBERS) + ") USING (\"column\")")
def numeric_summary(spark, sf):
    return univariate.numeric_summary(C.normalised(table(spark, sf, "lineitem")), NUMBERS)


@query("\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS q FROM {t}" for t, c in (("events", "value"), ("lineitem", "l_extendedprice")) for p in _PCT))
def percentiles(spark, sf):
    return univariate.percentiles(table(spark, sf, "events"), ["value"]).unionByName(univariate.percentiles(table(spark, sf, "lineitem"), ["l_extendedprice"]))


@query(_each("SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM events", ["value"]) + "\nUNION ALL SELECT 'zero', 0e0, 0e0")
def skew_kurtosis(spark, sf):
    return univariate.moments(table(spark, sf, "events").withColumn("zero", F.lit(0.0)), ["value", "zero"]).select("column", "skewness", "kurtosis")


@query(_OUT.replace("{t}", "events").replace("{c}", "value"))
def outliers(spark, sf):
    return univariate.outliers(table(spark, sf, "events"), ["value"])


_CATS = ["o_orderstatus", "o_orderpriority"]


@query(_each("SELECT '{c}' AS \"column\", coalesce({c}, '<MISSING>') AS value, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS percentage, CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '<MISSING>')) AS INTEGER) AS rank FROM orders GROUP BY {c}", _CATS))
def categorical_summary(spark, sf):
    return univariate.categorical_summary(table(spark, sf, "orders"), _CATS)


@query(_each("""SELECT '{c}' AS "column", count(*) AS unique_count, count(*) FILTER (WHERE r) AS rare_category_count, CAST(coalesce(sum(n) FILTER (WHERE r), 0) AS BIGINT) AS rare_row_count, round(coalesce(sum(n) FILTER (WHERE r), 0) / CAST(sum(n) AS DOUBLE), 6) AS rare_row_percentage
FROM (SELECT count(*) AS n, count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) < 0.01 AS r FROM part GROUP BY {c})""", ["p_brand", "p_type", "p_name"]))
def rare_categories(spark, sf):
    return univariate.rare_categories(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@query("SELECT 'ts' AS \"column\", count(ts) AS count, min(ts) AS min, max(ts) AS max, count(DISTINCT ts) AS unique_count, CAST(0 AS BIGINT) AS parse_failure_count FROM events")
def datetime_summary(spark, sf):
    return univariate.datetime_summary(table(spark, sf, "events"), ["ts"])


# response


@query(f"""SELECT coalesce(CAST(quality AS VARCHAR), '<MISSING>') AS class, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS percentage, CAST(quality AS DOUBLE) AS encoded_value FROM ({V5_SQL}) GROUP BY quality""")
def class_table(spark, sf):
    return response.class_table(view(spark, sf, V5_SQL), "quality", "1").withColumn("encoded_value", F.col("encoded_value").cast("double"))


@query("""SELECT round(avg(quality), 6) AS response_rate, least(sum(quality), count(*) - sum(quality)) AS minority_count, greatest(sum(quality), count(*) - sum(quality)) AS majority_count,
  round(greatest(sum(quality), count(*) - sum(quality)) / CAST(least(sum(quality), count(*) - sum(quality)) AS DOUBLE), 6) AS imbalance_ratio FROM labels""".replace("least(sum(quality), count(*) - sum(quality)) AS m", "CAST(least(sum(quality), count(*) - sum(quality)) AS BIGINT) AS m").replace("greatest(sum(quality), count(*) - sum(quality)) AS m", "CAST(greatest(sum(quality), count(*) - sum(quality)) AS BIGINT) AS m"))
def imbalance(spark, sf):
    return response.imbalance(table(spark, sf, "labels"), F.col("quality"))


_RANKED = """(SELECT y, avg(r) OVER (PARTITION BY x) AS k FROM (SELECT y, x, CAST(row_number() OVER (ORDER BY x) AS DOUBLE) AS r FROM (SELECT {y} AS y, {c} AS x FROM lineitem WHERE {c} IS NOT NULL)))""".replace("{y}", _Y)
_AUC = """SELECT '{c}' AS "column", count(*) AS n, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM """ + _RANKED


@query(_each(_AUC, NUMBERS))
def numeric_auc(spark, sf):
    return response.numeric_relationships(table(spark, sf, "lineitem"), _y(), NUMBERS).select("column", "n", "auc")


@query(_each("SELECT '{c}' AS \"column\", round(corr(k, y), 6) AS spearman FROM " + _RANKED, NUMBERS))
def spearman_binary(spark, sf):
    return response.numeric_relationships(table(spark, sf, "lineitem"), _y(), NUMBERS).select("column", "spearman")


@query(_each("SELECT '{c}' AS \"column\", round(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2, 6) AS mann_whitney_u FROM " + _RANKED, NUMBERS))
def mann_whitney_u(spark, sf):
    return response.numeric_relationships(table(spark, sf, "lineitem"), _y(), NUMBERS).select("column", "mann_whitney_u")


@query(_each(f"""SELECT '{{c}}' AS "column", round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 4) AS degrees FROM (
  SELECT avg(x) FILTER (WHERE y = 1) AS m1, avg(x) FILTER (WHERE y = 0) AS m0, var_samp(x) FILTER (WHERE y = 1) AS v1, var_samp(x) FILTER (WHERE y = 0) AS v0, count(x) FILTER (WHERE y = 1) AS n1, count(x) FILTER (WHERE y = 0) AS n0
  FROM (SELECT {{c}} AS x, {_Y} AS y FROM lineitem))""", NUMBERS))
def welch_t(spark, sf):
    return response.welch_t(table(spark, sf, "lineitem"), _y(), NUMBERS).withColumn("degrees", F.round("degrees", 4))


_BINNED = f"""WITH d AS (SELECT {{c}} AS x, {_Y} AS y FROM lineitem), e AS (
  SELECT list_sort(list_distinct(list_value({", ".join(f"quantile_cont(x, {i / 10})" for i in range(11))}))) AS edges FROM d), b AS (
  SELECT x, y, edges, greatest(1, len(list_filter(edges, lambda v: v < x))) AS bin FROM d, e)
SELECT '{{c}}' AS "column", bin, round(edges[bin], 6) AS low, round(edges[bin + 1], 6) AS high, count(*) AS n, round(avg(y), 6) AS response_rate FROM b GROUP BY bin, edges"""


@query("SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_BINNED.replace("{c}", c) for c in ("l_quantity", "l_discount", "l_extendedprice")) + ")")
def qcut_rates(spark, sf):
    return response.quantile_bins(table(spark, sf, "lineitem"), _y(), ["l_quantity", "l_discount", "l_extendedprice"])


_TREND = "WITH r AS (" + _BINNED.replace("round(avg(y), 6)", "avg(y)").replace("{c}", "l_discount").replace("WITH d AS", "WITH d AS", 1) + """), s AS (SELECT *, response_rate - lag(response_rate) OVER (ORDER BY bin) AS d FROM r)
SELECT 'l_discount' AS "column", round(max(response_rate) - min(response_rate), 6) AS response_rate_spread, round(arg_min(response_rate, bin), 6) AS bottom_bin_rate, round(arg_max(response_rate, bin), 6) AS top_bin_rate,
  (bool_and(coalesce(d >= 0, true)) OR bool_and(coalesce(d <= 0, true))) AS monotonic,
  CASE WHEN bool_and(coalesce(d >= 0, true)) AND bool_and(coalesce(d <= 0, true)) THEN 'flat' WHEN bool_and(coalesce(d >= 0, true)) THEN 'increasing' WHEN bool_and(coalesce(d <= 0, true)) THEN 'decreasing' ELSE 'mixed' END AS trend FROM s"""


@query(_TREND)
def monotonic_trend(spark, sf):
    return response.bin_trend(response.quantile_bins(table(spark, sf, "lineitem"), _y(), ["l_discount"]))


@query(f"SELECT coalesce(l_returnflag, '<MISSING>') AS category, count(*) AS n, round(avg({_Y}), 6) AS mean_response FROM ({V1_SQL}) GROUP BY l_returnflag ORDER BY avg({_Y}) DESC, n DESC, category LIMIT 20")
def category_rates(spark, sf):
    return response.category_rates(view(spark, sf, V1_SQL), "l_returnflag", _y())


_CHI = """WITH c AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {t} GROUP BY ALL), e AS (
  SELECT n, sum(n) OVER (PARTITION BY x) * sum(n) OVER (PARTITION BY y) / CAST(sum(n) OVER () AS DOUBLE) AS e, sum(n) OVER () AS total FROM c)
SELECT '{x}' AS "column", CAST(max(total) AS BIGINT) AS n, round(sum(power({gap}, 2) / e), 6) AS chi_square, CAST({d} AS BIGINT) AS degrees, round(sqrt(sum(power({gap}, 2) / e) / max(total)), 6) AS cramers_v FROM e"""


def _chi(x, y, t, gap, d):
    return _CHI.replace("{x}", x).replace("{y}", y).replace("{t}", t).replace("{gap}", gap).replace("{d}", str(d))


@query("SELECT * FROM (" + _chi("l_returnflag", "l_linestatus", "lineitem", "n - e", 2) + ") UNION ALL SELECT * FROM (" + _chi("quality", "toxic", "labels", "abs(n - e) - least(0.5, abs(n - e))", 1) + ")")
def chi_square(spark, sf):
    return response.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").unionByName(response.chi_square(table(spark, sf, "labels"), "quality", "toxic"))


@query(f"""WITH v AS ({V1_SQL}), c AS (SELECT coalesce(l_returnflag, '<MISSING>') AS x, l_linestatus AS y, count(*) AS n FROM v GROUP BY ALL), e AS (
  SELECT n, sum(n) OVER (PARTITION BY x) * sum(n) OVER (PARTITION BY y) / CAST(sum(n) OVER () AS DOUBLE) AS e, sum(n) OVER () AS total FROM c)
SELECT 'l_returnflag' AS "column", round(sqrt(sum(power(n - e, 2) / e) / max(total)), 6) AS cramers_v FROM e""")
def cramers_v(spark, sf):
    return response.chi_square(view(spark, sf, V1_SQL), "l_returnflag", "l_linestatus").select("column", "cramers_v")


@query(f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS parse_failure_count, {_MOMENTS}, {_QUANT}, o.unique_count, o.iqr_outlier_count, o.p01_p99_outlier_count, false AS zero_variance
FROM orders, ({_OUT.replace("{t}", "orders")}) AS o GROUP BY o.unique_count, o.iqr_outlier_count, o.p01_p99_outlier_count""".replace("{c}", "o_totalprice"))
def regression_target(spark, sf):
    return response.regression_target(table(spark, sf, "orders"), "o_totalprice")


_SPEAR = """SELECT '{c}' AS "column", count(*) AS n, round(corr({c}, l_extendedprice), 6) AS pearson, round(corr(a, b), 6) AS spearman, CASE WHEN abs(corr(a, b)) < 1e-12 THEN 'none' WHEN corr(a, b) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (
  SELECT {c}, l_extendedprice, avg(ra) OVER (PARTITION BY {c}) AS a, avg(rb) OVER (PARTITION BY l_extendedprice) AS b FROM (
    SELECT {c}, l_extendedprice, row_number() OVER (ORDER BY {c}) AS ra, row_number() OVER (ORDER BY l_extendedprice) AS rb FROM lineitem))"""


@query(_each(_SPEAR, ["l_quantity", "l_discount", "l_tax"]))
def regression_corr(spark, sf):
    return response.regression_correlations(table(spark, sf, "lineitem"), F.col("l_extendedprice"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT coalesce(o_orderpriority, '<MISSING>') AS category, count(*) AS n, round(avg(o_totalprice), 6) AS mean_response FROM orders GROUP BY o_orderpriority ORDER BY avg(o_totalprice) DESC, n DESC, category LIMIT 20")
def category_target_means(spark, sf):
    return response.category_rates(table(spark, sf, "orders"), "o_orderpriority", F.col("o_totalprice"))


# pairs of columns


def _corrs(columns, source) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS correlation FROM {source}" for i, a in enumerate(columns) for b in columns[i + 1 :])


@query(_corrs(NUMBERS, "lineitem"))
def correlation_matrix(spark, sf):
    return bivariate.correlation_matrix(table(spark, sf, "lineitem"), NUMBERS)


@query("SELECT * FROM (" + _corrs([*NUMBERS, "qty_copy", "price2"], f"({V3_SQL})") + ") WHERE abs(correlation) >= 0.8")
def high_corr_pairs(spark, sf):
    return bivariate.high_correlations(view(spark, sf, V3_SQL))


def _equal(columns, source) -> str:
    return "SELECT \"left\", \"right\" FROM (" + "\nUNION ALL\n".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM {source}" for i, a in enumerate(columns) for b in columns[i + 1 :]) + ") WHERE same"


@query(_equal([*NUMBERS, "qty_copy", "price2"], f"({V3_SQL})"))
def duplicate_columns(spark, sf):
    return bivariate.duplicate_columns(view(spark, sf, V3_SQL))


_HOLES = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"WITH v AS ({V1_SQL})\n" + _corrs(_HOLES, "v"))
def correlations_by_blocks(spark, sf):
    """Over the rows where both columns are there; blocks of three columns."""
    return bivariate.correlations(view(spark, sf, V1_SQL), _HOLES, block=3)


@query(f"WITH v AS ({V1_SQL})\n" + "\nUNION ALL\n".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER)), 6) AS correlation FROM v" for a, b in _PAIRS))
def missing_flags_by_blocks(spark, sf):
    return bivariate.correlations(view(spark, sf, V1_SQL), _GONE, [F.col(c).isNull().cast("double") for c in _GONE], block=2)


# groups


@query(f"WITH v AS ({V1_SQL})\n" + _each("""SELECT '{c}' AS "column", round((avg({c}) FILTER (WHERE split = 'train') - avg({c}) FILTER (WHERE split = 'test')) / sqrt((var_samp({c}) FILTER (WHERE split = 'train') + var_samp({c}) FILTER (WHERE split = 'test')) / 2), 6) AS smd FROM v""", NUMBERS))
def drift_smd(spark, sf):
    return drift.standardised_differences(view(spark, sf, V1_SQL), "split", "train", "test", NUMBERS)


@query(f"WITH v AS ({V1_SQL})\n" + _each("""SELECT '{c}' AS "column", round(sum((a - e) * ln(a / e)), 6) AS psi FROM (
  SELECT count(*) FILTER (WHERE split = 'train') / CAST((SELECT count(*) FROM v WHERE split = 'train') AS DOUBLE) + 1e-6 AS e, count(*) FILTER (WHERE split = 'test') / CAST((SELECT count(*) FROM v WHERE split = 'test') AS DOUBLE) + 1e-6 AS a FROM v GROUP BY {c})""", ["l_returnflag", "l_linestatus"]))
def drift_psi(spark, sf):
    return drift.population_stability(view(spark, sf, V1_SQL), "split", "train", "test", ["l_returnflag", "l_linestatus"])


_COMPARED = """SELECT '{c}' AS "column", round(gr, 6) AS reference_missing, round(gc, 6) AS current_missing, round(mr, 6) AS reference_mean, round(mc, 6) AS current_mean, round(gc - gr, 6) AS missing_delta, round(mc - mr, 6) AS mean_delta, round(coalesce(mc - mr, gc - gr), 6) AS change_score FROM (
  SELECT avg(CAST({c} IS NULL AS INTEGER)) FILTER (WHERE split = 'train') AS gr, avg(CAST({c} IS NULL AS INTEGER)) FILTER (WHERE split = 'test') AS gc, avg({c}) FILTER (WHERE split = 'train') AS mr, avg({c}) FILTER (WHERE split = 'test') AS mc FROM v)"""


@query(f"WITH v AS ({V1_SQL})\n" + _each(_COMPARED, NUMBERS))
def group_comparison(spark, sf):
    return drift.comparison(view(spark, sf, V1_SQL), "split", "train", "test", NUMBERS)


@query("""WITH g AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS v, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey % 50 < 30) AS r, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 50 >= 5) AS c FROM orders GROUP BY 1)
SELECT count(*) FILTER (WHERE r > 0) AS reference_unique, count(*) FILTER (WHERE c > 0) AS current_unique, count(*) FILTER (WHERE r = 0 AND c > 0) AS new_count, count(*) FILTER (WHERE c = 0 AND r > 0) AS removed_count,
  array_to_string(list_sort(list(v) FILTER (WHERE r = 0 AND c > 0))[1:10], ',') AS new_values, array_to_string(list_sort(list(v) FILTER (WHERE c = 0 AND r > 0))[1:10], ',') AS removed_values, round(10 / CAST(count(*) FILTER (WHERE c > 0) AS DOUBLE), 6) AS change_score FROM g""")
def category_set_delta(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).cast("string").alias("v"), (F.col("o_custkey") % 50).alias("k"), F.when(F.col("o_orderdate") < "1996-01-01", "reference").otherwise("current").alias("half"))
    rows = rows.where(((F.col("half") == "reference") & (F.col("k") < 30)) | ((F.col("half") == "current") & (F.col("k") >= 5)))
    out = drift.category_changes(rows, "half", "reference", "current", ["v"])
    return out.select("reference_unique", "current_unique", "new_count", "removed_count", F.array_join("new_values", ",").alias("new_values"), F.array_join("removed_values", ",").alias("removed_values"), "change_score")


# texts and times


@query(r"""SELECT 'text' AS "column", count(text) AS count, round(avg(length(text)), 6) AS mean_length, round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))), 6) AS mean_words, count(*) FILTER (WHERE trim(text) = '') AS blank_count, round(quantile_cont(length(text), 0.95), 6) AS p95_length FROM documents""")
def text_summary(spark, sf):
    return text_time.text_summary(table(spark, sf, "documents"), ["text"])


@query("""WITH s AS (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_]{2,}')) AS term FROM documents)
SELECT term, count(*) AS n FROM s GROUP BY term ORDER BY n DESC, term LIMIT 20""")
def top_terms(spark, sf):
    return text_time.top_terms(table(spark, sf, "documents"), "text", first=None)


_GAPS = "SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 1e6 AS g FROM events"


@query(f"SELECT 'ts' AS \"column\", count(g) AS gaps, round(max(g), 6) AS largest_gap_seconds, round(quantile_cont(g, 0.5), 6) AS median_gap_seconds FROM ({_GAPS})")
def time_gaps(spark, sf):
    return text_time.time_gaps(table(spark, sf, "events"), "ts")


@query(f"SELECT CASE WHEN m IS NULL OR m <= 0 THEN NULL WHEN m <= 60 THEN 'sub_hourly' WHEN m <= 3600 THEN 'hourly' WHEN m <= 86400 THEN 'daily' WHEN m <= 604800 THEN 'weekly' ELSE 'irregular_or_monthly_plus' END AS frequency FROM (SELECT quantile_cont(g, 0.5) AS m FROM ({_GAPS}))")
def inferred_frequency(spark, sf):
    return text_time.time_gaps(table(spark, sf, "events"), "ts").select(text_time.frequency(F.col("median_gap_seconds")).alias("frequency"))


@query("SELECT 'ts' AS \"column\", bool_and(coalesce(ts >= p, true)) AS monotonic_increasing FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events) UNION ALL SELECT 'value', bool_and(coalesce(value >= p, true)) FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM events)")
def monotonic_order(spark, sf):
    events = table(spark, sf, "events")
    return text_time.rises_in_order(events, "ts", F.col("event_id")).unionByName(text_time.rises_in_order(events, "value", F.col("event_id")))


# evidence as frames


@query(f"""WITH v AS ({V2_SQL}), f AS (
  SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) / CAST(count(*) AS DOUBLE) AS u, 0 AS blanks, count(DISTINCT c_custkey) AS d, false AS text FROM v
  UNION ALL SELECT 'c_name', count(DISTINCT c_name) / CAST(count(*) AS DOUBLE), 0, count(DISTINCT c_name), true FROM v
  UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) / CAST(count(*) AS DOUBLE), 0, count(DISTINCT c_acctbal), false FROM v
  UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) / CAST(count(*) AS DOUBLE), count(*) FILTER (WHERE trim(c_mktsegment) = ''), count(DISTINCT c_mktsegment), true FROM v)
SELECT "column", 'high_cardinality' AS issue_type, 'medium' AS severity, CAST(d AS DOUBLE) AS metric_value FROM f WHERE text AND d > 50
UNION ALL SELECT "column", 'id_like_candidate', 'low', round(u, 6) FROM f WHERE u >= 0.95
UNION ALL SELECT "column", 'blank_strings', 'low', CAST(blanks AS DOUBLE) FROM f WHERE blanks > 0""")
def dq_warnings(spark, sf):
    return ranking.quality_flags(view(spark, sf, V2_SQL).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


_LEAKY = f"SELECT *, l_linenumber + CASE WHEN l_linestatus = 'O' THEN 100 ELSE 0 END AS hint FROM lineitem"


@query("SELECT \"column\", 'high_auc' AS reason, 'high' AS severity, round(greatest(auc, 1 - auc), 6) AS auc_abs FROM (" + _each(_AUC.replace("round((sum", "((sum").replace("), 6) AS auc", ")) AS auc").replace("FROM lineitem", f"FROM ({_LEAKY})"), ["l_quantity", "hint"]) + ") WHERE greatest(auc, 1 - auc) >= 0.98")
def leakage_warnings(spark, sf):
    found = response.numeric_relationships(view(spark, sf, _LEAKY), _y(), ["l_quantity", "hint"])
    return found.where(F.col("auc_abs") >= 0.98).select("column", F.lit("high_auc").alias("reason"), F.lit("high").alias("severity"), "auc_abs")


_POSITION = "CASE \"column\" WHEN 'l_quantity' THEN 0 WHEN 'l_extendedprice' THEN 1 WHEN 'l_discount' THEN 2 ELSE 3 END"


@query(f"""SELECT "column", round(s, 6) AS signal_score, CAST(row_number() OVER (ORDER BY s DESC, {_POSITION}) AS INTEGER) AS rank FROM (SELECT "column", 2 * abs(greatest(auc, 1 - auc) - 0.5) AS s FROM (""" + _each(_AUC.replace("round((sum", "((sum").replace("), 6) AS auc", ")) AS auc"), NUMBERS) + "))")
def feature_ranking(spark, sf):
    found = response.numeric_relationships(table(spark, sf, "lineitem"), _y(), NUMBERS)
    position = F.array_position(F.array(*[F.lit(c) for c in NUMBERS]), F.col("column"))
    rows = found.select("column", (2 * F.abs(F.col("auc_abs") - 0.5)).alias("signal_score"), F.lit(0.0).alias("quality_penalty"), F.lit(False).alias("has_leakage"), position.alias("position"))
    return ranking.ranked_features(rows).select("column", "signal_score", "rank")


@query("""SELECT risk_id, severity, position FROM (SELECT p_brand AS risk_id, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, p_partkey AS position,
  row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, p_partkey) AS r FROM part) WHERE r = 1""")
def risk_dedupe(spark, sf):
    severity = F.when(F.col("p_size") % 3 == 0, "low").when(F.col("p_size") % 3 == 1, "medium").otherwise("high")
    return ranking.most_severe(table(spark, sf, "part").select(F.col("p_brand").alias("risk_id"), severity.alias("severity"), F.col("p_partkey").alias("position")), "risk_id", "severity", "position")


_GATE = """SELECT '{c}' AS c, CASE WHEN avg(CAST({c} IS NULL AS INTEGER)) >= 0.95 THEN 'fail' WHEN avg(CAST({c} IS NULL AS INTEGER)) >= 0.4 THEN 'warn' ELSE 'pass' END AS status FROM v"""


@query(f"WITH v AS ({V1_SQL}), s AS (" + _each(_GATE, V1_COLUMNS) + """)
SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'fail') AS n_fail, CAST(0 AS BIGINT) AS n_not_applicable, count(*) AS total,
  CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS overall_status FROM s""")
def quality_gate(spark, sf):
    gone = missingness.column_missingness(view(spark, sf, V1_SQL), V1_COLUMNS)
    m = F.col("missing_percentage")
    return ranking.gate(gone.select(F.when(m >= 0.95, "fail").when(m >= 0.4, "warn").otherwise("pass").alias("status")))


_HALF = """SELECT p_type AS "column", row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part WHERE p_size {op} 25 GROUP BY p_type"""


@query(f"""WITH a AS ({_HALF.replace("{op}", "<=")}), b AS ({_HALF.replace("{op}", ">")})
SELECT coalesce(a."column", b."column") AS "column", CAST(coalesce(a.r, 0) AS INTEGER) AS left_rank, CAST(coalesce(b.r, 0) AS INTEGER) AS right_rank, CASE WHEN a.r IS NULL THEN 'new' WHEN b.r IS NULL THEN 'removed' WHEN a.r = b.r THEN 'same' ELSE 'moved' END AS change
FROM (SELECT * FROM a WHERE r <= 20) a FULL OUTER JOIN (SELECT * FROM b WHERE r <= 20) b ON a."column" = b."column" """)
def run_rank_delta(spark, sf):
    """Two rankings of the part types, by frequency among small and among large parts; the top 20 is the report's."""
    part = table(spark, sf, "part")
    rank = lambda rows: rows.groupBy(F.col("p_type").alias("column")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "column")))
    return ranking.rank_changes(rank(part.where("p_size <= 25")), rank(part.where("p_size > 25")))


@query("SELECT c_custkey, '<REDACTED>' AS c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5")
def redacted_sample(spark, sf):
    """The first five rows are the sample that a report shows."""
    from . import workflow

    return workflow.redacted(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").limit(5), ["c_name"], "redacted")


@query(f"WITH v AS ({V1_SQL})\n" + "SELECT \"column\", round(smd, 6) AS value, CASE WHEN abs(smd) >= 0.5 THEN 'fail' WHEN abs(smd) >= 0.2 THEN 'warn' ELSE 'pass' END AS status FROM (" + _each("""SELECT '{c}' AS "column", (avg({c}) FILTER (WHERE split = 'train') - avg({c}) FILTER (WHERE split = 'test')) / sqrt((var_samp({c}) FILTER (WHERE split = 'train') + var_samp({c}) FILTER (WHERE split = 'test')) / 2) AS smd FROM v""", ["l_orderkey", *NUMBERS]) + ")")
def drift_status(spark, sf):
    return drift.drift(view(spark, sf, V1_SQL), "split", "train", "test", ["l_orderkey", *NUMBERS], []).select("column", "value", "status")


@query("SELECT coalesce(o_orderstatus, '<MISSING>') AS \"group\", count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_counts(spark, sf):
    return drift.group_counts(table(spark, sf, "orders"), "o_orderstatus")


# whole tables and rules, where the queries above show one case


@query(f"""WITH g AS (SELECT count(*) AS n FROM ({V7_SQL}) GROUP BY {_ALL})
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_percentage FROM g""")
def duplicate_whole_rows(spark, sf):
    return missingness.duplicate_rows(view(spark, sf, V7_SQL))


@query(r"""WITH n AS (SELECT column_name AS c, trim(regexp_replace(lower(column_name), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM (DESCRIBE SELECT c_custkey AS "Cust Key", c_name AS "cust-key", c_nationkey AS " CUST_KEY ", c_acctbal, c_mktsegment FROM customer))
SELECT k AS normalized_name, count(*) AS n FROM n GROUP BY k HAVING count(*) > 1""")
def name_collisions_of_a_table(spark, sf):
    given = table(spark, sf, "customer").select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("cust-key"), F.col("c_nationkey").alias(" CUST_KEY "), "c_acctbal", "c_mktsegment")
    return spark.createDataFrame([(k, len(v)) for k, v in rules.name_collisions(given.columns).items()], "normalized_name string, n long")


@query(r"""SELECT 'text' AS "column", round(avg(length(text)), 6) AS mean_length, round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))), 6) AS mean_words,
  avg(length(text)) >= 40 OR avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) >= 6 AS text_like FROM documents""")
def text_like_all(spark, sf):
    return typing.text_like(table(spark, sf, "documents"), ["text"], F.col("doc_id"), first=None)


_DAY = "regexp_matches({c}, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"


@query(f"WITH v AS ({V4_SQL})\n" + _each("SELECT '{c}' AS \"column\", CASE WHEN avg(CAST(regexp_matches({c}, '[0-9]') AS INTEGER)) < 0.85 THEN 0e0 ELSE round(avg(CAST(" + _DAY + " AS INTEGER)), 6) END AS datetime_parse_rate FROM v", ["day_text", "vague_text"]))
def datetime_parse_rates(spark, sf):
    return typing.parse_rates(view(spark, sf, V4_SQL), ["day_text", "vague_text"]).select("column", "datetime_parse_rate")


_TYPE_OF_TEXT = """SELECT '{c}' AS "column", CASE WHEN (SELECT avg(CAST(""" + _DAY + """ AS INTEGER)) >= 0.85 FROM (SELECT {c} FROM {t} ORDER BY {o} LIMIT 200)) THEN 'datetime'
  WHEN (SELECT avg(length({c})) >= 40 FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL ORDER BY {o} LIMIT 500)) THEN 'text' WHEN (SELECT count(DISTINCT {c}) FROM {t}) > 50 THEN 'categorical_high_cardinality' ELSE 'categorical_low_cardinality' END AS semantic_type"""


@query(f"WITH v AS ({V4_SQL})\n" + _each(_TYPE_OF_TEXT.replace("{t}", "v").replace("{o}", "o_orderkey"), ["day_text", "vague_text", "o_orderpriority"]) + "\nUNION ALL\n" + _each(_TYPE_OF_TEXT.replace("{t}", "documents").replace("{o}", "doc_id"), ["text", "lang", "source"]))
def types_of_texts(spark, sf):
    a = typing.semantic_types(view(spark, sf, V4_SQL).select("o_orderkey", "day_text", "vague_text", "o_orderpriority"), order=F.col("o_orderkey")).where(F.col("column") != "o_orderkey")
    b = typing.semantic_types(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), order=F.col("doc_id")).where(F.col("column") != "doc_id")
    return a.unionByName(b).select("column", "semantic_type")


_FACTS = """SELECT '{c}' AS "column", count({c}) AS nn, count(*) - count({c}) AS gone, count(*) AS n, count(DISTINCT {c}) AS u, (SELECT max(k) FROM (SELECT count(*) AS k FROM v WHERE {c} IS NOT NULL GROUP BY {c})) AS top,
  count(*) FILTER (WHERE {c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) = '') AS blanks FROM v"""
_FAULTY = ["c_custkey", "c_name", "empty", "one", "nearly", "half", "c_mktsegment"]


@query(f"WITH v AS ({V6_SQL}), f AS (" + _each(_FACTS, _FAULTY) + """)
SELECT "column", 'all_missing' AS issue_type, 'high' AS severity, 0e0 AS metric_value FROM f WHERE nn = 0
UNION ALL SELECT "column", 'high_missingness', 'medium', round(gone / CAST(n AS DOUBLE), 6) FROM f WHERE nn > 0 AND gone / CAST(n AS DOUBLE) >= 0.4
UNION ALL SELECT "column", 'constant_column', 'medium', 1e0 FROM f WHERE u = 1
UNION ALL SELECT "column", 'near_constant_column', 'low', round(top / CAST(nn AS DOUBLE), 6) FROM f WHERE u > 1 AND top / CAST(nn AS DOUBLE) >= 0.98
UNION ALL SELECT "column", 'high_cardinality', 'medium', CAST(u AS DOUBLE) FROM f WHERE "column" = 'c_name' AND u > 50
UNION ALL SELECT "column", 'id_like_candidate', 'low', round(u / CAST(nn AS DOUBLE), 6) FROM f WHERE nn > 0 AND u / CAST(nn AS DOUBLE) >= 0.95 AND n >= 20
UNION ALL SELECT "column", 'blank_strings', 'low', CAST(blanks AS DOUBLE) FROM f WHERE blanks > 0""")
def dq_warnings_of_every_kind(spark, sf):
    return ranking.quality_flags(view(spark, sf, V6_SQL))


#: The upper tail of the normal distribution by Simpson's rule over twelve deviations.
_TAIL = "list_sum(list_transform(range(0, 6001), lambda i: (CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({z} + i * 0.002, 2) / 2))) * 0.002 / 3 / sqrt(2 * pi())"
_LENGTHS = "SELECT d.n_chars, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query(f"""WITH r AS (SELECT n_chars AS x, CAST(toxic AS DOUBLE) AS y, avg(k) OVER (PARTITION BY n_chars) AS k, count(*) OVER (PARTITION BY n_chars) AS t FROM (SELECT *, CAST(row_number() OVER (ORDER BY n_chars) AS DOUBLE) AS k FROM ({_LENGTHS}))),
s AS (SELECT sum(y) AS a, count(*) - sum(y) AS b, CAST(count(*) AS DOUBLE) AS n, sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2 AS u, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r),
z AS (SELECT (greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM s),
c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY quality) * sum(n) OVER (PARTITION BY toxic) / CAST(sum(n) OVER () AS DOUBLE) AS e FROM c),
x AS (SELECT sqrt(sum(power(abs(n - e) - least(0.5, abs(n - e)), 2) / e)) AS z FROM e)
SELECT 'mann_whitney' AS test, round(least(1, 2 * {_TAIL.replace("{z}", "z")}), 6) AS p_value FROM z
UNION ALL SELECT 'chi_square', round(least(1, 2 * {_TAIL.replace("{z}", "z")}), 6) FROM x""")
def p_values(spark, sf):
    """Of the lengths of toxic and other texts, and of quality against toxicity."""
    r = response.numeric_relationships(view(spark, sf, _LENGTHS), F.col("toxic"), ["n_chars"]).first()
    c = response.chi_square(table(spark, sf, "labels"), "quality", "toxic").first()
    found = [("mann_whitney", special.mann_whitney_p(r["mann_whitney_u"], r["positives"], r["negatives"], r["tie_sum"])), ("chi_square", special.chi_square_p(c["chi_square"], c["degrees"]))]
    return spark.createDataFrame(found, "test string, p_value double")


@query("SELECT coalesce(lang, '<MISSING>') AS class, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS percentage FROM documents GROUP BY lang")
def multiclass_table(spark, sf):
    return response.class_table(table(spark, sf, "documents"), "lang").drop("encoded_value")


@query("SELECT max(l_linestatus) AS positive, min(l_linestatus) AS negative, round(avg(CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1e0 ELSE 0e0 END), 6) AS response_rate FROM lineitem")
def text_response(spark, sf):
    """A response of two texts, none of them a known label: the last by name is the positive class."""
    rows = table(spark, sf, "lineitem")
    classes = response.classes_of(rows, "l_linestatus")
    positive = response.positive_class(classes)
    negative = next(c for c in classes if c != positive)
    return response.imbalance(rows, response.encoded(F.col("l_linestatus"), positive, negative)).select(F.lit(positive).alias("positive"), F.lit(negative).alias("negative"), "response_rate")


@query(f"WITH v AS ({V1_SQL})\n" + _each("""SELECT '{c}' AS "column", 'population_stability_index' AS metric, round(psi, 6) AS value, CASE WHEN abs(psi) >= 0.5 THEN 'fail' WHEN abs(psi) >= 0.2 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT sum((a - e) * ln(a / e)) AS psi FROM (
  SELECT count(*) FILTER (WHERE split = 'train') / CAST((SELECT count(*) FROM v WHERE split = 'train') AS DOUBLE) + 1e-6 AS e, count(*) FILTER (WHERE split = 'test') / CAST((SELECT count(*) FROM v WHERE split = 'test') AS DOUBLE) + 1e-6 AS a FROM v GROUP BY {c}))""", ["l_returnflag", "l_linestatus"]) + """
UNION ALL SELECT 'l_tax', 'standardized_mean_difference', round(d, 6), CASE WHEN abs(d) >= 0.5 THEN 'fail' WHEN abs(d) >= 0.2 THEN 'warn' ELSE 'pass' END FROM (SELECT (avg(l_tax) FILTER (WHERE split = 'train') - avg(l_tax) FILTER (WHERE split = 'test')) / sqrt((var_samp(l_tax) FILTER (WHERE split = 'train') + var_samp(l_tax) FILTER (WHERE split = 'test')) / 2) AS d FROM v)""")
def drift_of_numbers_and_categories(spark, sf):
    return drift.drift(view(spark, sf, V1_SQL), "split", "train", "test", ["l_tax"], ["l_returnflag", "l_linestatus"])


_KIND = r"""SELECT '{c}' AS "column", CASE WHEN v = '' THEN 'blank' WHEN regexp_matches(v, '^[+-]?[0-9]{1,18}$') THEN 'whole' WHEN regexp_matches(v, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'number'
  WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(v AS DATE) IS NOT NULL THEN 'date' ELSE 'text' END AS kind FROM (SELECT trim({c}) AS v FROM v WHERE {c} IS NOT NULL)"""
_RAW = ["key_text", "day_text", "odd_text", "o_orderpriority"]


@query(f"WITH v AS ({V8_SQL}), k AS (" + _each(_KIND, _RAW) + """)
SELECT "column", kind, count(*) AS n FROM k GROUP BY "column", kind""")
def value_kinds(spark, sf):
    return typing.value_kinds(view(spark, sf, V8_SQL), _RAW)


@query(f"WITH v AS ({V8_SQL}), k AS (" + _each(_KIND, _RAW) + """), g AS (SELECT "column", CASE kind WHEN 'whole' THEN 'number' ELSE kind END AS kind, count(*) AS n FROM k WHERE kind <> 'blank' GROUP BY 1, 2)
SELECT "column", count(*) AS kinds, arg_max(kind, n) AS main_kind, CAST(sum(n) - max(n) AS BIGINT) AS other_values, count(*) > 1 AS mixed FROM g GROUP BY "column" """)
def mixed_values(spark, sf):
    return typing.mixed_values(typing.value_kinds(view(spark, sf, V8_SQL), _RAW))


_SIGNALS = ["l_quantity", "l_discount", "tax_result", "hint"]
_FOUND = f"WITH v AS ({V9_SQL}), a AS (" + _each(_AUC.replace("round((sum", "((sum").replace("), 6) AS auc", ")) AS auc").replace("FROM lineitem", "FROM v"), _SIGNALS) + "), g AS (" + _each("SELECT '{c}' AS \"column\", 1 - count({c}) / CAST(count(*) AS DOUBLE) AS gone FROM v", _SIGNALS) + """),
f AS (SELECT "column", gone, greatest(auc, 1 - auc) AS auc_abs, greatest(auc, 1 - auc) >= 0.98 AS leaks, "column" LIKE '%result%' AS named FROM a JOIN g USING ("column"))"""


def _leakage(spark, sf):
    """The view, its relations with the response, and what may leak."""
    rows = view(spark, sf, V9_SQL)
    y = response.encoded(F.col("l_linestatus"), "O", "F")
    found = response.numeric_relationships(rows, y, _SIGNALS).join(response.bin_trend(response.quantile_bins(rows, y, _SIGNALS)).select("column", "response_rate_spread"), "column", "left")
    names = spark.createDataFrame([(c, rules.suspicious(c)) for c in _SIGNALS], "column string, suspicious boolean")
    return rows, found, ranking.leakage_flags(found, names)


@query(_FOUND + """
SELECT "column", 'high_auc' AS issue_type, 'high' AS severity, round(auc_abs, 6) AS metric_value FROM f WHERE leaks
UNION ALL SELECT "column", 'suspicious_name', 'medium', 1e0 FROM f WHERE named""")
def leakage_flags(spark, sf):
    return _leakage(spark, sf)[2]


@query(_FOUND + """, p AS (SELECT *, CASE WHEN gone >= 0.4 THEN 0.25 ELSE 0 END + CASE WHEN leaks THEN 0.5 ELSE 0 END + CASE WHEN named THEN 0.25 ELSE 0 END AS penalty, 2 * (auc_abs - 0.5) AS s FROM f)
SELECT "column", round(gone, 6) AS missing_percentage, round(s, 6) AS signal_score, round(penalty, 6) AS quality_penalty, leaks OR named AS has_leakage, CASE WHEN gone >= 0.4 THEN 'high_missingness' ELSE '' END AS data_quality_warnings,
  CASE WHEN leaks THEN 'high_auc' WHEN named THEN 'suspicious_name' ELSE '' END AS leakage_warnings, CAST(row_number() OVER (ORDER BY leaks OR named DESC, s DESC, penalty) AS INTEGER) AS rank FROM p""")
def ranking_of_evidence(spark, sf):
    """Types, missing values, relations, quality and leakage, joined by column."""
    rows, found, leaks = _leakage(spark, sf)
    columns = spark.createDataFrame([(c, i) for i, c in enumerate(_SIGNALS)], "column string, position int")
    signals = found.select("column", (2 * F.abs(F.col("auc_abs") - 0.5)).alias("signal_score"))
    quality = ranking.quality_flags(rows.select(*_SIGNALS))
    out = ranking.ranking_of_evidence(columns, missingness.column_missingness(rows, _SIGNALS).select("column", "missing_percentage"), signals, quality, leaks)
    return out.drop("position").withColumns({c: F.array_join(c, ",") for c in ("data_quality_warnings", "leakage_warnings")})


# rules as rows: all quality issues, risks and checks of one faulty table

_RULED = ProfileConfig(response_column="l_linestatus", id_columns=("l_orderkey",), train_test_column="split")
_RULED_NUMBERS = ["l_quantity", "qty_copy", "l_discount", "tax_result", "hint", "price_seen", "moved"]
_RULED_TEXTS = ["l_linestatus", "part_text", "line_text", "split"]
_RULED_ALL = ["l_orderkey", *_RULED_NUMBERS, "one", *_RULED_TEXTS]


def _issues(*rows: tuple) -> str:
    """Of (issue, severity, metric, value, threshold, table, condition)."""
    out = []
    for i, s, m, v, t, f, w in rows:
        column = "NULL" if f == "whole" else '"column"'
        out.append(f"SELECT {column} AS \"column\", '{i}' AS issue_type, '{s}' AS severity, '{m}' AS metric_name, CAST({v} AS DOUBLE) AS metric_value, CAST({t} AS DOUBLE) AS threshold FROM {f} WHERE {w}")
    return "\nUNION ALL ".join(out)


_CODES = "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IN (-1, -9, -99, 999, 9999, 99999)) AS codes FROM v"
_TEXT_CODES = "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE lower(trim({c})) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'unknown', 'unk', 'missing', 'not available')) AS codes FROM v"
_READS = "SELECT '{c}' AS \"column\", avg(CAST(TRY_CAST({c} AS DOUBLE) IS NOT NULL AS INTEGER)) AS numbers, avg(CAST(lower({c}) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '0', '1') AS INTEGER)) AS flags FROM v"
_QUALITY = f"WITH v AS ({V10_SQL}), f AS (" + _each(_FACTS, _RULED_ALL) + "), codes AS (" + _each(_CODES, ["l_orderkey", *_RULED_NUMBERS, "one"]) + "\nUNION ALL\n" + _each(_TEXT_CODES, _RULED_TEXTS) + "), reads AS (" + _each(_READS, _RULED_TEXTS) + """),
whole AS (SELECT (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS again),
ids AS (SELECT 'l_orderkey' AS "column", count(*) - count(DISTINCT l_orderkey) AS again FROM v), q AS (""" + _issues(
    ("duplicate_rows", "medium", "duplicate_row_count", "again", 1, "whole", "again > 0"), ("duplicate_id_values", "high", "duplicate_id_count", "again", 1, "ids", "again > 0"),
    ("numeric_parse_candidate", "low", "numeric_parse_rate", "numbers", 0.95, "reads", "numbers >= 0.95"), ("boolean_parse_candidate", "low", "boolean_parse_rate", "flags", 1, "reads", "flags = 1"),
    ("all_missing", "high", "non_null_count", "nn", 0, "f", "nn = 0"), ("high_missingness", "medium", "missing_percentage", "gone / CAST(n AS DOUBLE)", 0.4, "f", "nn > 0 AND gone / CAST(n AS DOUBLE) >= 0.4"),
    ("constant_column", "medium", "unique_count", "u", 1, "f", "u = 1"), ("near_constant_column", "low", "top_frequency_ratio", "top / CAST(nn AS DOUBLE)", 0.98, "f", "u > 1 AND top / CAST(nn AS DOUBLE) >= 0.98"),
    ("high_cardinality", "medium", "category_count", "u", 51, "f", "u > 50 AND \"column\" LIKE '%text'"), ("id_like_candidate", "low", "unique_ratio", "u / CAST(nn AS DOUBLE)", 0.95, "f", "nn > 0 AND u / CAST(nn AS DOUBLE) >= 0.95 AND n >= 20 AND \"column\" <> 'l_orderkey'"),
    ("suspicious_column_name", "medium", "suspicious_name", "1", 1, "f", "\"column\" LIKE '%result%'"), ("blank_strings", "low", "blank_string_count", "blanks", 1, "f", "blanks > 0"), ("special_missing_codes", "low", "special_missing_code_count", "codes", 1, "codes", "codes > 0"),
) + ")"


@contextlib.contextmanager
def _ruled(spark, sf):
    """The view and its value table by class, which goes at the end; the evidence of its columns and the quality findings, each taken
    once."""
    rows = view(spark, sf, V10_SQL)
    with ranks.held(ranks.value_table(rows, rows.columns, response.encoded(F.col("l_linestatus"), "O", "F"))) as counts:
        seen = rulebook.kept(rulebook.column_evidence(rows, _RULED, [c for c in rows.columns if rules.suspicious(c) and c != "l_linestatus"], [len(v) for v in rules.name_collisions(rows.columns).values()], counts))
        yield rows, counts, seen, rulebook.kept(rulebook.findings(seen, rulebook.quality_rules(_RULED)))


@query(_QUALITY + "\nSELECT concat(issue_type, '.', coalesce(\"column\", 'dataset')) AS warning_id, \"column\", issue_type, severity, metric_name, round(metric_value, 6) AS metric_value, threshold FROM q")
def quality_issues(spark, sf):
    with _ruled(spark, sf) as (_, _, _, found):
        return found


_PAIRS = [(a, b) for i, a in enumerate(["l_orderkey", *_RULED_NUMBERS]) for b in ["l_orderkey", *_RULED_NUMBERS][i + 1 :]]
_GAP = "SELECT '{c}' AS \"column\", abs(avg(CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END) FILTER (WHERE {c} IS NULL) - avg(CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END) FILTER (WHERE {c} IS NOT NULL)) AS gap FROM v"
_SMD = "SELECT '{c}' AS \"column\", 'standardized_mean_difference' AS metric, abs((avg({c}) FILTER (WHERE split = 'train') - avg({c}) FILTER (WHERE split = 'test')) / sqrt((var_samp({c}) FILTER (WHERE split = 'train') + var_samp({c}) FILTER (WHERE split = 'test')) / 2)) AS value FROM v"
_PSI = """SELECT '{c}', 'population_stability_index', (SELECT abs(sum((a - e) * ln(a / e))) FROM (
  SELECT count(*) FILTER (WHERE split = 'train') / CAST((SELECT count(*) FROM v WHERE split = 'train') AS DOUBLE) + 1e-6 AS e, count(*) FILTER (WHERE split = 'test') / CAST((SELECT count(*) FROM v WHERE split = 'test') AS DOUBLE) + 1e-6 AS a FROM v GROUP BY {c}))"""
_PLACE = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_RULED_NUMBERS)) + " END"
_RISKS = _QUALITY + ", a AS (" + _each(_AUC.replace("round((sum", "((sum").replace("), 6) AS auc", ")) AS auc").replace("FROM lineitem", "FROM v"), _RULED_NUMBERS) + """),
k AS (SELECT "column", 'high_auc' AS issue_type, 'high' AS severity, greatest(auc, 1 - auc) AS metric_value FROM a WHERE greatest(auc, 1 - auc) >= 0.98 UNION ALL SELECT "column", 'suspicious_name', 'medium', 1e0 FROM f WHERE "column" LIKE '%result%'),
gaps AS (""" + _each(_GAP, [c for c in _RULED_ALL if c != "l_linestatus"]) + "), c AS (" + "\nUNION ALL ".join(f"SELECT '{a}' AS \"column\", '{b}' AS other, abs(corr({a}, {b})) AS r, count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) = 0 AS same FROM v" for a, b in _PAIRS) + """),
d AS (""" + _each(_SMD, _RULED_NUMBERS) + "\nUNION ALL " + _each(_PSI, ["part_text", "line_text"]) + """),
weights AS (SELECT "column", CASE severity WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.25 ELSE 0.1 END AS w FROM (SELECT "column", severity FROM q UNION ALL SELECT "column", severity FROM k)),
pen AS (SELECT "column", least(1e0, CAST(sum(w) AS DOUBLE)) AS penalty FROM weights GROUP BY "column"),
ranked AS (SELECT "column", penalty, row_number() OVER (ORDER BY leaks DESC, s DESC, penalty, """ + _PLACE + """) AS rank FROM (SELECT "column", coalesce(penalty, 0) AS penalty, 2 * (greatest(auc, 1 - auc) - 0.5) AS s, "column" IN (SELECT "column" FROM k) AS leaks FROM a LEFT JOIN pen USING ("column"))),
even AS (SELECT greatest(o, n - o) / CAST(least(o, n - o) AS DOUBLE) AS ratio FROM (SELECT count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM v)),
risk AS (SELECT concat('leakage.', "column", '.', issue_type) AS risk_id, 'leakage' AS category, severity, "column", NULL AS related_column, issue_type AS metric_name, metric_value FROM k
UNION ALL SELECT concat(category, '.', issue_type, '.', coalesce("column", 'dataset')), category, severity, "column", NULL, metric_name, metric_value FROM (SELECT *, CASE WHEN issue_type = 'high_cardinality' THEN 'cardinality' WHEN issue_type = 'id_like_candidate' THEN 'identifier'
  WHEN issue_type IN ('high_missingness', 'all_missing') THEN 'missingness' WHEN issue_type LIKE '%constant_column' THEN 'sparsity' WHEN issue_type LIKE '%parse_candidate' THEN 'schema' END AS category FROM q) WHERE category IS NOT NULL
UNION ALL SELECT concat('cardinality.', "column"), 'cardinality', 'medium', "column", NULL, metric_name, metric_value FROM q WHERE issue_type = 'high_cardinality'
UNION ALL SELECT concat('sparsity.', "column"), 'sparsity', severity, "column", NULL, metric_name, metric_value FROM q WHERE issue_type LIKE '%constant_column' AND "column" NOT IN ('l_linestatus', 'split', 'l_orderkey')
UNION ALL SELECT concat('missingness_response.', "column"), 'missingness', 'medium', "column", NULL, 'response_rate_gap', gap FROM gaps WHERE gap >= 0.2
UNION ALL SELECT concat('correlation.', "column", '.', other), 'correlation', 'medium', "column", other, 'abs_correlation', r FROM c WHERE r >= 0.8
UNION ALL SELECT concat('duplicate_column.', "column", '.', other), 'duplicate_column', 'medium', "column", other, 'duplicate_column_pair', 1 FROM c WHERE same
UNION ALL SELECT concat('drift.', "column", '.', metric), 'drift', CASE WHEN value >= 0.5 THEN 'high' ELSE 'medium' END, "column", NULL, metric, value FROM d WHERE value >= 0.2
UNION ALL SELECT 'response.severe_class_imbalance', 'response', 'high', 'l_linestatus', NULL, 'imbalance_ratio', ratio FROM even WHERE ratio >= 10
UNION ALL SELECT concat('ranked_feature_quality.', "column"), 'ranked_feature_quality', 'medium', "column", NULL, 'quality_penalty', penalty FROM ranked WHERE rank <= 10 AND penalty >= 0.5)"""


def _at_risk(spark, sf):
    """Evidence of all sources, quality, leakage and risks of the view, each taken once."""
    with _ruled(spark, sf) as (rows, counts, seen, quality):
        y = response.encoded(F.col("l_linestatus"), "O", "F")
        found = response.numeric_relationships(rows, y, _RULED_NUMBERS, counts).join(response.bin_trend(response.quantile_bins(rows, y, _RULED_NUMBERS, counts=counts)).select("column", "response_rate_spread"), "column", "left")
        names = spark.createDataFrame([(c, rules.suspicious(c)) for c in rows.columns if c != "l_linestatus"], "column string, suspicious boolean")
        found = rulebook.kept(found.select("column", "auc_abs", "response_rate_spread"))
        leaks = rulebook.kept(ranking.leakage_flags(found, names))
        places = spark.createDataFrame([(c, i) for i, c in enumerate(_RULED_NUMBERS)], "column string, position int")
        signals = found.select("column", (2 * F.abs(F.col("auc_abs") - 0.5)).alias("signal_score"))
        gone = seen.where("metric = 'missing_percentage'").select("column", F.col("value").alias("missing_percentage"))
        ranked = ranking.ranking_of_evidence(places, gone, signals, quality, leaks).where("rank <= 10 AND signal_score IS NOT NULL")
        numbers, ev = C.numeric_columns(rows, booleans=True), rulebook.evidence
        others = [c for c in rows.columns if c != "l_linestatus"]
        parts = (
            seen, ev(missingness.missing_by_response(rows, y, others, counts), "missing_by_response", "response_rate_gap", F.abs("response_rate_gap")), ev(bivariate.high_correlations(rows, numbers, _RULED.high_correlation_threshold), "pairs", "abs_correlation", F.abs("correlation"), "left", "right"),
            ev(bivariate.duplicate_columns(rows, numbers), "pairs", "duplicate_column_pair", F.lit(1), "left", "right"), ev(drift.drift(rows, "split", "train", "test", _RULED_NUMBERS, ["part_text", "line_text"]), "drift", F.col("metric"), F.abs("value")),
            ev(response.imbalance(rows, y), "response", "imbalance_ratio", "imbalance_ratio", F.lit("l_linestatus")), ev(spark.range(1), "response", "positive_class", F.lit(1), F.lit("l_linestatus")), ev(ranked, "ranking", "quality_penalty", "quality_penalty"),
        )
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        every = rulebook.kept(every.where(F.col("value").isNotNull()))
    return every, quality, leaks, rulebook.risks(every, quality, leaks, _RULED)


@query(_RISKS + "\nSELECT risk_id, category, severity, \"column\", related_column, metric_name, round(metric_value, 6) AS metric_value FROM risk")
def modeling_risks(spark, sf):
    return _at_risk(spark, sf)[3]


@query(_RISKS + """, gate AS (SELECT 'quality' AS part, concat('quality.', issue_type, '.', coalesce("column", 'dataset'), '.', coalesce("column", 'dataset')) AS check_id, CASE severity WHEN 'high' THEN 'fail' ELSE 'warn' END AS status FROM q
UNION ALL SELECT 'leakage', concat('leakage.', "column"), CASE severity WHEN 'high' THEN 'fail' ELSE 'warn' END FROM k
UNION ALL SELECT 'missingness', concat('missingness.high.', "column"), CASE WHEN gone / CAST(n AS DOUBLE) >= 0.95 THEN 'fail' ELSE 'warn' END FROM f WHERE gone / CAST(n AS DOUBLE) >= 0.4
UNION ALL SELECT 'correlation', concat('correlation.high.', "column", '.', other), 'warn' FROM c WHERE r >= 0.8
UNION ALL SELECT 'drift', concat('drift.', metric, '.', "column"), CASE WHEN value >= 0.5 THEN 'fail' ELSE 'warn' END FROM d WHERE value >= 0.2
UNION ALL SELECT 'response', 'response.severe_class_imbalance.l_linestatus', 'fail' FROM even WHERE ratio >= 10
UNION ALL SELECT 'response', 'response.positive_class_auto_selected.l_linestatus', 'pass'
UNION ALL SELECT 'modeling_risk', concat('modeling_risk.', risk_id), CASE severity WHEN 'high' THEN 'fail' ELSE 'warn' END FROM risk UNION ALL SELECT 'dataset', 'dataset.non_empty', 'pass')
SELECT * FROM gate
UNION ALL SELECT p, c, 'pass' FROM (VALUES ('missingness', 'missingness.high_columns'), ('correlation', 'correlation.high_pairs'), ('drift', 'drift.thresholds'), ('modeling_risk', 'modeling_risk.review_queue')) AS quiet (p, c) WHERE p NOT IN (SELECT part FROM gate)""")
def gate_checks(spark, sf):
    """All parts of the gate; those without a finding pass."""
    every, quality, leaks, at_risk = _at_risk(spark, sf)
    return rulebook.checks(every, quality, leaks, at_risk, _RULED, compared=True)


@query(f"""WITH v AS ({V11_SQL}), r AS (SELECT paid, TRY_CAST(paid AS DOUBLE) AS y FROM v),
s AS (SELECT count(*) - count(paid) AS gone, count(paid) - count(y) AS failed, count(y) / CAST(count(paid) AS DOUBLE) AS rate, count(y) AS n, abs(skewness(y)) AS skew, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, min(y) = max(y) AS flat FROM r),
o AS (SELECT count(*) AS far FROM r, s WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))
SELECT 'missing_response_values.paid' AS warning_id, 'high' AS severity, 'missing_response_count' AS metric_name, CAST(gone AS DOUBLE) AS metric_value FROM s WHERE gone > 0
UNION ALL SELECT 'unparseable_regression_response_values.paid', 'medium', 'parse_failure_count', CAST(failed AS DOUBLE) FROM s WHERE failed > 0
UNION ALL SELECT 'numeric_string_response_inferred_as_regression.paid', 'medium', 'numeric_parse_rate', round(rate, 6) FROM s WHERE rate >= 0.95
UNION ALL SELECT 'unusable_regression_response.paid', 'high', 'count', CAST(n AS DOUBLE) FROM s WHERE n < 3
UNION ALL SELECT 'zero_variance_regression_response.paid', 'high', 'zero_variance', 1e0 FROM s WHERE flat AND n >= 3
UNION ALL SELECT 'regression_response_outliers.paid', 'medium', 'iqr_outlier_count', CAST(far AS DOUBLE) FROM o WHERE far > 0
UNION ALL SELECT 'skewed_regression_response.paid', 'medium', 'skewness_size', round(skew, 6) FROM s WHERE skew >= 2""")
def regression_warnings(spark, sf):
    target = response.regression_target(view(spark, sf, V11_SQL), "paid")
    return rulebook.findings(rulebook.regression_evidence(target, "paid", True), rulebook.regression_rules()).select("warning_id", "severity", "metric_name", "metric_value")


#: The middle of Student's distribution by Simpson's rule.
_MIDDLE = "list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(i * abs(t) / 4000, 2) / d, -(d + 1) / 2))) * abs(t) / 12000 * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi())"


@query("WITH w AS (" + _each(f"""SELECT '{{c}}' AS "column", (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS d FROM (
  SELECT avg(x) FILTER (WHERE y = 1) AS m1, avg(x) FILTER (WHERE y = 0) AS m0, var_samp(x) FILTER (WHERE y = 1) AS v1, var_samp(x) FILTER (WHERE y = 0) AS v0, count(x) FILTER (WHERE y = 1) AS n1, count(x) FILTER (WHERE y = 0) AS n0
  FROM (SELECT {{c}} AS x, {_Y} AS y FROM lineitem))""", NUMBERS) + f""")
SELECT "column", round(t, 6) AS t, round(greatest(0e0, 1 - 2 * {_MIDDLE}), 6) AS p_value FROM w""")
def welch_p_values(spark, sf):
    """Two-sided; the tail is taken on the driver, for a row of each column."""
    found = response.welch_t(table(spark, sf, "lineitem"), _y(), NUMBERS).collect()
    return spark.createDataFrame([(r["column"], r["t"], special.t_p(r["t"], r["degrees"])) for r in found], "column string, t double, p_value double")
