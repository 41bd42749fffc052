import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.functions import special
from quarrylens.operators import bivariate, drift, missingness, response, text_time, typing, univariate
from quarrylens.plans import rules


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_numeric_summary(spark):
    df = frame(spark, [(1.0, 5), (2.0, 5), (3.0, 5), (100.0, 5), (None, 5)], "x double, k int")
    got = by(univariate.numeric_summary(df, ["x", "k"]))
    assert got["x"]["median"] == 2.5 and got["x"]["iqr_outlier_count"] == 1 and got["x"]["count"] == 4
    assert got["k"]["skewness"] == 0 and got["k"]["kurtosis"] == 0 and got["k"]["std"] == 0


def test_missing_counts(spark):
    df = frame(spark, [(1, None, ""), (0, 999.0, "UNKNOWN"), (1, 0.0, None), (0, 5.0, "a")], "target int, number double, category string")
    got = by(missingness.column_missingness(df))
    assert got["number"]["missing_count"] == 1 and got["number"]["zero_count"] == 1 and got["category"]["blank_string_count"] == 1
    codes = {(r.column, r.code): r.n for r in missingness.special_missing_codes(df).collect()}
    assert codes == {("category", ""): 1, ("category", "unknown"): 1, ("number", "999"): 1}


def test_perfect_feature(spark):
    df = frame(spark, [(0.1, "a", 0), (0.2, "a", 0), (0.3, "a", 0), (0.7, "b", 1), (0.8, "b", 1), (0.9, "b", 1)], "score double, category string, target int")
    y = F.col("target").cast("double")
    rel = by(response.numeric_relationships(df, y, ["score"]))["score"]
    assert rel["auc"] == 1 and rel["auc_abs"] == 1 and rel["mann_whitney_u"] == 9
    trend = by(response.bin_trend(response.quantile_bins(df, y, ["score"])))["score"]
    assert trend["response_rate_spread"] == 1 and trend["monotonic"] and trend["trend"] == "increasing"
    rates = response.category_rates(df, "category", y).collect()
    assert [(r.category, r.mean_response) for r in rates] == [("b", 1.0), ("a", 0.0)]


def test_imbalance_and_missing_response(spark):
    df = frame(spark, [(1,)] + [(0,)] * 10 + [(None,)], "target int")
    assert response.imbalance(df, F.col("target")).first().imbalance_ratio == 10
    assert {r["class"]: r["n"] for r in response.class_table(df, "target", "1").collect()} == {"1": 1, "0": 10, "<MISSING>": 1}


def test_positive_class():
    assert response.positive_class(["no", "yes"]) == "yes" and response.positive_class(["t", "1"]) == "t" and response.positive_class(["b", "a"]) == "b" and response.positive_class(["x", "y"], "x") == "x"


def test_constant_columns_have_no_correlation(spark):
    df = frame(spark, [(0.1, 1.0), (0.1, 2.0), (0.1, 4.0)], "k double, x double")
    assert bivariate.correlation_matrix(df).first().correlation is None


def test_chi_square_yates(spark):
    rows = [("a", 0)] * 49 + [("a", 1)] * 9 + [("b", 0)] * 299 + [("b", 1)] * 42
    got = response.chi_square(frame(spark, rows, "x string, y int"), "x", "y").first()
    assert got.chi_square == pytest.approx(0.213609, abs=1e-6) and got.degrees == 1


def test_tail_probabilities():
    assert special.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi_square_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi_square_p(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.mann_whitney_p(9, 3, 3, 0) == pytest.approx(0.1)
    assert special.mann_whitney_p(4.5, 3, 3, 0.5) == pytest.approx(1.0, abs=0.2)


def test_drift_of_equal_groups_is_nothing(spark):
    df = frame(spark, [(float(i % 5), "abc"[i % 3], s) for i in range(30) for s in ("train", "test")], "x double, c string, split string")
    assert by(drift.standardised_differences(df, "split", "train", "test", ["x"]))["x"]["smd"] == 0
    assert by(drift.population_stability(df, "split", "train", "test", ["c"]))["c"]["psi"] == pytest.approx(0, abs=1e-12)


def test_group_choice():
    assert drift.chosen_groups(["holdout", "test", "train"]) == ("train", "test")
    assert drift.chosen_groups(["b", "a", "c"]) == ("b", "a")
    assert drift.chosen_groups(["only"]) is None


def test_new_and_removed_categories(spark):
    df = frame(spark, [("a", "r"), ("b", "r"), (None, "r"), ("b", "c"), ("x", "c"), ("y", "c")], "v string, g string")
    got = drift.category_changes(df, "g", "r", "c", ["v"]).first()
    assert got.new_values == ["x", "y"] and got.removed_values == ["a"] and got.change_score == pytest.approx(2 / 3)


def test_semantic_types(spark):
    rows = [(f"id{i:03d}", i % 2, i, i / 7, "same", "yes" if i % 3 else "no", f"2024-01-{i % 28 + 1:02d}", f"a long note of many words number {i} and more to read", None) for i in range(30)]
    df = frame(spark, rows, "key string, flag int, age int, ratio double, one string, said string, day string, note string, gone string")
    got = {r.column: r.semantic_type for r in typing.semantic_types(df, high_cardinality=20).collect()}
    assert got == {"key": "categorical_high_cardinality", "flag": "boolean", "age": "numeric_continuous", "ratio": "numeric_continuous", "one": "constant", "said": "boolean", "day": "datetime", "note": "text", "gone": "all_missing"}


def test_parse_rates(spark):
    df = frame(spark, [("1.5", "2024-01-01", "yes"), ("1d", "2024-02-01", "no"), (" 2 ", "x", "y"), ("", None, "maybe")], "n string, d string, b string")
    got = by(typing.parse_rates(df, ["n", "d", "b"]))
    assert got["n"]["numeric_parse_rate"] == pytest.approx(2 / 3) and got["d"]["datetime_parse_rate"] == 0 and got["b"]["boolean_parse_rate"] == 0.75


def test_time_gaps_and_order(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * id as int),0) as ts, id from range(200)")
    got = text_time.time_gaps(df, "ts").first()
    assert got.gaps == 199 and got.largest_gap_seconds == (199**2 - 198**2) * 60 and got.median_gap_seconds == 199 * 60
    assert text_time.rises_in_order(df, "ts", F.col("id")).first().monotonic_increasing
    assert not text_time.rises_in_order(df, "ts", -F.col("id")).first().monotonic_increasing


def test_names():
    assert rules.name_collisions(["Account ID", "account-id", "x"]) == {"account_id": ["Account ID", "account-id"]}
    assert rules.name_warnings("Unnamed: 0") == ["unnamed_column"] and rules.name_warnings(" a ") == ["edge_whitespace"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, c string, y int")
    assert missingness.shape(df).first().rows == 0
    assert missingness.duplicate_rows(df).first().duplicate_rows == 0
    assert {r.semantic_type for r in typing.semantic_types(df).collect()} == {"all_missing"}
    assert univariate.numeric_summary(df, ["x"]).first()["count"] == 0
    assert response.numeric_relationships(df, F.col("y"), ["x"]).count() == 0
    assert text_time.time_gaps(df.select(F.lit(None).cast("timestamp").alias("t")), "t").count() == 0


def test_quantiles_match_any_partitioning(spark):
    r = random.Random(4)
    values = sorted(round(r.expovariate(1), 2) for _ in range(500))
    for parts in (1, 4, 16):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        for row in univariate.percentiles(df, ["x"]).collect():
            at = (len(values) - 1) * row.p
            lo = values[math.floor(at)]
            assert row.q == pytest.approx(lo + (values[min(math.floor(at) + 1, len(values) - 1)] - lo) * (at - math.floor(at)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.booleans()), min_size=3, max_size=30))
def test_auc_of_the_mirror(spark, pairs):
    df = spark.createDataFrame([(float(x), -float(x), float(y)) for x, y in pairs], "a double, b double, y double")
    got = by(response.numeric_relationships(df, F.col("y"), ["a", "b"]))
    if got["a"]["auc"] is None:
        assert got["b"]["auc"] is None
    else:
        assert got["a"]["auc"] == pytest.approx(1 - got["b"]["auc"])
