"""What decides how the work is split: size estimates, ranges, shared counts, blocks of columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.config import ProfileConfig
from quarrylens.functions import columns as C
from quarrylens.functions import ranks
from quarrylens.operators import bivariate, missingness, response, typing, univariate
from quarrylens.plans import evidence, workflow
from quarrylens.sources import tables


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    df = tables.sample_table(spark, 500)
    df.write.parquet(f"file://{root}/t.parquet")
    df.coalesce(1).write.csv(f"file://{root}/t.csv", header=True)
    return f"file://{root}"


def test_sizes_of_files_are_told(spark, files):
    for name in ("t.parquet", "t.csv"):
        loaded = tables.load(spark, f"{files}/{name}")
        assert loaded.rows == 500 and 1000 < loaded.bytes < 10**6
    df = spark.read.parquet(f"{files}/t.parquet")
    joined = df.crossJoin(df.select(F.col("age").alias("other")))
    assert ranks.source_bytes(joined) <= 2 * ranks.source_bytes(df)  # not their product
    assert ranks.source_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")) is None


def test_cuts_follow_the_size():
    one = ranks.BYTES_OF_A_RANGE
    assert [ranks._cuts(n) for n in (0, one, one + 1, one * ranks.RANGES, one * ranks.RANGES + 1, 10**18, None)] == [0, 0, 1, 1, 2, 4, 2]


def test_results_are_those_of_any_cut(spark, monkeypatch):
    r = random.Random(1)
    rows = [(round(r.gauss(0, 3), 1), float(i), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, u double, y int")
    seen = []
    for cuts in (0, 1, 2):
        monkeypatch.setattr(ranks, "_cuts", lambda size, cuts=cuts: cuts)
        q = univariate.percentiles(df, ["x", "u"]).orderBy("column", "p").collect()
        a = response.numeric_relationships(df, F.col("y"), ["x", "u"]).orderBy("column").collect()
        seen.append((q, [[round(v, 9) if isinstance(v, float) else v for v in row] for row in a]))
    assert seen[0] == seen[1] == seen[2]


def test_value_table_gives_what_scans_give(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 0.0, -0.0, 1.5, 2.0]), r.choice([1, 2, 2**53, 2**53 + 1, None]), r.choice(["a", "b", None, "<MISSING>"]), r.random() < 0.5, r.choice([0, 1, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, k long, c string, b boolean, y int")
    y = F.col("y").cast("double")
    t = ranks.value_table(df, df.columns, y)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(typing.cardinality(df), typing.cardinality(df, counts=t))
    assert same(univariate.numeric_summary(df, ["x", "k"]), univariate.numeric_summary(df, ["x", "k"], t))
    assert same(univariate.categorical_summary(df, ["c", "b"]), univariate.categorical_summary(df, ["c", "b"], counts=t))
    assert same(univariate.rare_categories(df, ["c", "x"], 0.2), univariate.rare_categories(df, ["c", "x"], 0.2, t))
    assert same(response.numeric_relationships(df, y, ["x", "k", "b"]), response.numeric_relationships(df, y, ["x", "k", "b"], t))
    assert same(response.quantile_bins(df, y, ["x", "k"]), response.quantile_bins(df, y, ["x", "k"], counts=t))
    assert same(response.all_category_rates(df, ["c", "b"], y), response.all_category_rates(df, ["c", "b"], y, counts=t))
    rounded = lambda d: C.rounded(d, 9)
    assert same(rounded(response.chi_squares(df, ["c", "b"], "y")), rounded(response.chi_squares(df, ["c", "b"], "y", t)))


def test_a_run_counts_values_once_and_caches_small_inputs(spark, files, monkeypatch):
    calls = []
    real = ranks.value_table
    monkeypatch.setattr(ranks, "value_table", lambda *a, **k: calls.append("table") or real(*a, **k))
    monkeypatch.setattr(ranks, "value_counts", lambda *a, **k: calls.append("counts"))
    monkeypatch.setattr(ranks, "long_numbers", lambda *a, **k: calls.append("numbers"))
    cached = []
    df = spark.read.parquet(f"{files}/t.parquet")
    whole = missingness.duplicate_rows
    monkeypatch.setattr(missingness, "duplicate_rows", lambda d: cached.append(d.is_cached) or whole(d))
    packet = workflow.run(df, ProfileConfig(response_column="defaulted")).packet
    assert calls == ["table"] and cached == [True]
    assert packet["dataset_overview"]["memory_usage_bytes"] == tables.scan_bytes(df) > 0
    assert packet["response_summary"]["problem_type"] == "binary_classification"
    cached.clear()
    monkeypatch.setattr(workflow, "CACHED_BYTES", 10)
    workflow.run(df, ProfileConfig(profile_depth="minimal"))
    assert cached == [False]


def test_correlations_of_a_thousand_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 1000))
    x[:, 999] = x[:, 0] * 2 + 1e9
    x[:, 998] = 7.0
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    names = [f"c{i}" for i in range(1000)]
    got = bivariate.correlations(rows, names, [F.col("v")[i] for i in range(1000)])
    found = {(r.left, r.right): r.correlation for r in got.collect()}
    assert len(found) == 1000 * 999 // 2
    for _ in range(300):
        i, j = sorted(rng.choice(998, 2, replace=False))
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert found[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert found["c0", "c999"] == pytest.approx(1.0, abs=1e-6) and found["c5", "c998"] is None


def test_blocks_equal_the_aggregation_and_split_scans(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [[None if rng.random() < 0.2 else float(v) for v in rng.normal(size=7)] for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"a{i} double" for i in range(7)))
    want = {(r.left, r.right): r.correlation for r in bivariate.correlation_matrix(df).collect()}
    monkeypatch.setattr(bivariate, "SUM_BYTES", 1)  # each pair of blocks by itself
    got = {(r.left, r.right): r.correlation for r in bivariate.correlations(df, df.columns, block=2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert bivariate.correlations(df.limit(0), df.columns).collect() == []


def test_equal_columns_of_any_number(spark):
    df = spark.range(40).select("id", *[((F.col("id") * (i + 3)) % (i + 5)).alias(f"c{i}") for i in range(150)])
    df = df.withColumns({"x": F.col("c7"), "y": F.col("c7"), "z": F.when(F.col("id") != 3, F.col("c7")), "w": F.when(F.col("id") != 3, F.col("c7")), "real": F.col("c7").cast("double"), "turned": F.lit(39) - F.col("id"), "id2": F.col("id")})
    got = {tuple(r) for r in bivariate.duplicate_columns(df).collect()}
    assert got == {("c7", "x"), ("c7", "y"), ("x", "y"), ("z", "w"), ("id", "id2")} | {p for p in got if p[0].startswith("c") and p[1].startswith("c")}
    again = spark.createDataFrame([(1, 1, 2), (1, 1, 2)], "a int, b int, c int")  # rows twice
    assert [tuple(r) for r in bivariate.duplicate_columns(again).collect()] == [("a", "b")]


def test_missing_values_count_by_place(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (None, None)], "a int, b int")
    assert missingness.duplicate_rows(df).first().duplicate_rows == 1


def test_dates_read_by_one_format(spark):
    texts = ["2024-02-29", "2024-02-30", "2024-1-1", "2024-01-01 10:00:00", "2024-01-01T10:00:00", "2024/01/31", "12/31/2024", "31/12/2024", "31-12-2024", "12-31-2024", "soon", "", None, "2024-01-01 25:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.date_format(F.col("t"))).collect()]
    want = [r[0] for r in df.select(F.coalesce(*[F.when(C.parsed_time(F.col("t"), f).isNotNull(), F.lit(i)) for i, f in enumerate(C.DATE_FORMATS)])).collect()]
    assert got == want == [0, None, None, 1, 2, 3, 4, None, 5, None, None, None, None, None]


def test_kinds_of_values(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("x",), ("",), ("true",), ("2024-01-01",), (None,)], "v string")
    kinds = typing.value_kinds(df, ["v"])
    assert {r.kind: r.n for r in kinds.collect()} == {"whole": 1, "number": 1, "text": 1, "blank": 1, "boolean": 1, "date": 1}
    r = typing.mixed_values(kinds).first()
    assert (r.kinds, r.main_kind, r.other_values, r.mixed) == (4, "number", 3, True)


def test_summary_takes_the_weightiest(spark):
    told = evidence.summary(workflow.run(tables.sample_table(spark), ProfileConfig(response_column="defaulted", train_test_column="split")).packet)
    for part in evidence.PARTS:
        assert len(told[part]) <= evidence.FEW and all(set(x) == {"id", "text", "evidence_section", "column"} for x in told[part])
    assert told["recommendations"] and told["calculated_metrics"] and told["limitations"]
    assert evidence.summary({})["observed_facts"] == [] and evidence.summary({})["status"] == "deterministic_fallback"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    r = random.Random(5)
    rows = [(r.choice([None, 0.0, -0.0, 1.5, 999.0]), r.choice([None, 1, -9, 7]), r.choice([None, "", " NA ", "12", "2024-01-05", "x y"]), r.choice([None, True, False]), r.choice([0, 1, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, k long, c string, b boolean, y int")
    df.write.parquet(path := f"file://{tmp_path_factory.mktemp('odd')}/t.parquet")
    return spark.read.parquet(path)


def _rows(df):
    return sorted(map(str, C.rounded(df, 9).collect()))


def test_files_are_counted_column_by_column(odd, monkeypatch):
    y = F.col("y").cast("double")
    assert ranks.by_passes(odd, odd.columns) and not ranks.by_passes(odd.union(odd), odd.columns)
    alone = _rows(ranks.value_table(odd, odd.columns, y))
    monkeypatch.setattr(ranks, "PASSES", 0)
    assert alone == _rows(ranks.value_table(odd, odd.columns, y))


def test_facts_of_a_value_table_are_those_of_scans(spark, odd):
    y = F.col("y").cast("double")
    for df in (odd, odd.where("false"), odd.withColumn("none", F.lit(None).cast("string"))):
        with ranks.held(ranks.value_table(df, df.columns, y)) as t:
            assert _rows(missingness.column_missingness(df)) == _rows(missingness.column_missingness(df, counts=t))
            assert _rows(missingness.special_missing_codes(df)) == _rows(missingness.special_missing_codes(df, counts=t))
            assert _rows(missingness.duplicate_ids(df, ["k", "c"])) == _rows(missingness.duplicate_ids(df, ["k", "c"], t))
            assert _rows(missingness.missing_by_response(df, y, ["x", "c"])) == _rows(missingness.missing_by_response(df, y, ["x", "c"], t))
            assert _rows(typing.parse_rates(df, ["c"])) == _rows(typing.parse_rates(df, ["c"], t))


def test_rank_sums_of_broadcast_and_joined_ranks(odd, monkeypatch):
    data = odd.select(F.col("k").cast("double").alias("__y"), F.col("x").alias("x"), F.col("b").cast("int").cast("double").alias("b"))
    pairs = [(r["x"], r["__y"]) for r in data.collect() if r["x"] is not None and r["__y"] is not None]
    rank = lambda v, among: sum(a < v for a in among) + (sum(a == v for a in among) + 1) / 2
    xs, ys = zip(*pairs)
    rx, ry = [rank(v, xs) for v in xs], [rank(v, ys) for v in ys]
    want = (len(pairs), sum(rx), sum(ry), sum(a * a for a in rx), sum(b * b for b in ry), sum(a * b for a, b in zip(rx, ry)))
    for few, passes in ((100, 50), (0, 50), (100, 0), (0, 0)):
        monkeypatch.setattr(ranks, "PASSES", passes)
        got = {r["column"]: r for r in response.rank_sums(data, ["x", "b"], few).collect()}
        assert tuple(got["x"][c] for c in ("m", "sx", "sy", "sxx", "syy", "sxy")) == pytest.approx(want) and len(got) == 2


def test_a_task_sorts_sixteen_megabytes_of_a_source():
    assert [ranks._cuts(n << 20) for n in (16, 17, 128, 512, 513)] == [0, 1, 1, 1, 2]


def test_first_texts_of_files_are_those_of_one_scan(odd, monkeypatch):
    order = F.monotonically_increasing_id()
    alone = _rows(typing._firsts(odd, ["c"], order, 20).select("column", "nth", "v"))
    monkeypatch.setattr(ranks, "PASSES", 0)
    assert len(alone) == 20 and alone == _rows(typing._firsts(odd, ["c"], order, 20).select("column", "nth", "v"))


def test_pairs_of_more_than_few_columns_are_products(spark):
    r = random.Random(6)
    df = spark.createDataFrame([[r.choice([None, r.random()]) for _ in range(6)] for _ in range(200)], ", ".join(f"c{i} double" for i in range(6)))
    found = bivariate.matrix(df, df.columns)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and _rows(found) == _rows(bivariate.correlation_matrix(df))
