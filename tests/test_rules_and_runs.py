"""Rules as rows against the run's packet; run folders by URI; the order of source rows."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrylens.config import ProfileConfig
from quarrylens.operators import ranking, rulebook
from quarrylens.plans import artifacts, rules, shared_runs, workflow
from quarrylens.sources import tables

CONFIG = ProfileConfig(dataset_name="loans", response_column="defaulted", id_columns=("account_id",), train_test_column="split", profile_depth="minimal")


@pytest.fixture(scope="module")
def given(spark):
    rows = tables.sample_table(spark)
    late = F.when(F.col("age") % 3 == 0, F.col("income"))
    return rows.select("*", F.lit(None).cast("double").alias("empty"), F.lit(7).alias("same"), late.alias("final_amount"), F.when(F.col("age") % 2 == 0, "unknown").otherwise(" ").alias("note"), F.col("age").cast("string").alias("Region_"))


@pytest.fixture(scope="module")
def result(given):
    return workflow.run(given, CONFIG)


def test_quality_rules_give_what_the_run_gives(spark, given, result):
    suspicious = [c for c in given.columns if rules.suspicious(c) and c != "defaulted"]
    seen = rulebook.kept(rulebook.column_evidence(given, CONFIG, suspicious, [len(v) for v in rules.name_collisions(given.columns).values()]))
    found = rulebook.findings(seen, rulebook.quality_rules(CONFIG)).collect()
    want = {(w["issue_type"], w["column"], w["severity"]) for w in result.packet["data_quality_warnings"]}
    assert {(r["issue_type"], r["column"], r["severity"]) for r in found} == want
    assert {"all_missing", "high_missingness", "constant_column", "suspicious_column_name", "blank_strings", "special_missing_codes", "numeric_parse_candidate", "normalized_name_collision", "datetime_parse_candidate"} <= {r["issue_type"] for r in found}
    assert {r["warning_id"] for r in found} == {w["warning_id"] for w in result.packet["data_quality_warnings"]}


def test_limits_hold_at_their_ends(spark):
    rows = [("drift", "a", None, "population_stability_index", v) for v in (0.1999, 0.2, 0.4999, 0.5, 9.0)] + [("columns", "a", None, "unique_count", v) for v in (0.0, 1.0, 2.0)] + [("other", "a", None, "unique_count", 1.0)]
    found = rulebook.applied(spark.createDataFrame(rows, "source string, column string, related string, metric string, value double"), rulebook.risk_rules(CONFIG))
    assert sorted((r["value"], r["label"], r["severity"]) for r in found.collect()) == [(0.2, "drift", "medium"), (0.4999, "drift", "medium"), (0.5, "drift", "high"), (1.0, "sparsity", "medium"), (9.0, "drift", "high")]


def test_gate_without_findings(spark):
    none = spark.createDataFrame([], "source string, column string, related string, metric string, value double")
    quality = rulebook.findings(none, rulebook.quality_rules(CONFIG))
    leaks = spark.createDataFrame([], "column string, issue_type string, severity string, metric_value double")
    at_risk = rulebook.risks(none, quality, leaks, CONFIG)
    assert at_risk.count() == 0
    got = {r["check_id"]: r["status"] for r in rulebook.checks(none, quality, leaks, at_risk, CONFIG, compared=True).collect()}
    assert got == {"dataset.non_empty": "pass", "missingness.high_columns": "pass", "correlation.high_pairs": "pass", "drift.thresholds": "pass", "modeling_risk.review_queue": "pass"}
    alone = rulebook.checks(none, quality, leaks, at_risk, CONFIG, compared=False, ignored_groups=2)
    assert {r["check_id"] for r in alone.where("part IN ('drift', 'ignored')").collect()} == {"drift.available", "drift.ignored_groups"}
    assert ranking.gate(alone).first()["overall_status"] == "warn"


def test_runs_by_uri(spark, result, tmp_path):
    uri = f"file://{tmp_path}/shared"
    assert shared_runs.history(spark, uri).count() == 0
    packet = result.packet | {"feature_ranking": list(reversed(result.packet["feature_ranking"]))}
    packet["feature_ranking"] = [r | {"rank": n} for n, r in enumerate(packet["feature_ranking"], 1)]
    first = shared_runs.export(spark, result.packet, "text", CONFIG, uri)
    second = shared_runs.export(spark, packet, "text", CONFIG, uri)
    third = shared_runs.export(spark, packet, "text", replace(CONFIG, dataset_name="other"), uri)
    assert len({first, second, third}) == 3
    base = tmp_path / "shared"
    assert {p.name for p in base.iterdir()} == {first, second, third}  # nothing is left aside
    (base / f"{shared_runs.STAGED}lost").mkdir()
    (base / f"{shared_runs.STAGED}lost" / "run_metadata.json").write_text("{}")
    told = {r["run"]: r for r in shared_runs.history(spark, uri).collect()}
    assert {r["status"] for r in told.values()} == {"available"} and set(told) == {first, second, third}
    assert told[third]["dataset_name"] == "other" and told[first]["row_count"] == 80 and told[first]["artifact_count"] == 15
    assert {r["state"] for r in shared_runs.file_states(spark, uri).collect()} == {"same"}
    assert json.loads((base / first / "config_snapshot.json").read_text()) == CONFIG.to_dict()

    moves = {r["column"]: (r["left_rank"], r["right_rank"]) for r in shared_runs.rank_changes(spark, uri, first, second).collect()}
    n = len(result.packet["feature_ranking"])
    assert all(a + b == n + 1 for a, b in moves.values()) and len(moves) == n
    shared_runs.rankings(spark, uri).createOrReplaceTempView("all_rankings")
    best = spark.sql("SELECT run, column FROM all_rankings WHERE rank = 1").collect()
    assert {r["run"]: r["column"] for r in best}[first] == result.packet["feature_ranking"][0]["column"] and len(best) == 3

    for path, text in ((base / second / "run_metadata.json", '{"run_id": '), (base / first / "eda_report.md", "changed"), (base / first / "more.txt", "new"), (base / first / "quality_checks.csv", None), (base / third / "artifact_manifest.json", None)):
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)  # the local file system's own sums
        path.unlink() if text is None else path.write_text(text)
    told = {r["run"]: (r["status"], r["errors"]) for r in shared_runs.history(spark, uri).collect()}
    assert told == {first: ("available", []), second: ("incomplete", ["run_metadata.json: not JSON"]), third: ("incomplete", ["artifact_manifest.json: missing"])}
    states = {(r["run"], r["file"]): r["state"] for r in shared_runs.file_states(spark, uri).where("state <> 'same'").collect() if r["run"] != third}
    assert states == {(first, "eda_report.md"): "changed", (first, "more.txt"): "unlisted", (first, "quality_checks.csv"): "missing", (second, "run_metadata.json"): "changed"}


def test_local_and_shared_files_are_the_same(spark, result, tmp_path):
    local = artifacts.export(result.packet, "text", CONFIG, tmp_path / "local")
    name = shared_runs.export(spark, result.packet, "text", CONFIG, f"file://{tmp_path}/shared")
    for file in ("evidence_packet.json", "quality_checks.csv", "eda_report.md", "eda_report.html", "feature_ranking.csv"):
        assert (local / file).read_bytes() == (tmp_path / "shared" / name / file).read_bytes()


def test_run_exports_to_a_uri(spark, given, tmp_path):
    uri = f"file://{tmp_path}/runs"
    folder = workflow.run(given.limit(30), replace(CONFIG, train_test_column=None), export=True, base_dir=uri).folder
    run = shared_runs.history(spark, uri).first()
    assert folder == f"{uri}/{run['run']}" and (run["status"], run["row_count"]) == ("available", 30)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_order_of_source_rows(spark, tmp_path, block):
    """Rows of two CSV files and of a filtered Parquet table come in the order of their files, however they are split."""
    for part in range(2):
        (tmp_path / "t.csv").mkdir(exist_ok=True)
        (tmp_path / "t.csv" / f"part-{part}.csv").write_text("n,word\n" + "".join(f"{part * 300 + i},{'abc'[i % 3]}\n" for i in range(300)))
    spark.createDataFrame([(i, "abc"[i % 3]) for i in range(600)], "n int, word string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        for df in (tables.read_csv(spark, str(tmp_path / "t.csv")), tables.read_parquet(spark, str(tmp_path / "t.parquet"))):
            for rows, want in ((df, range(600)), (df.where("word <> 'b'").select("n"), [i for i in range(600) if i % 300 % 3 != 1])):
                ordered = tables.with_order(rows, "o")
                assert [r["n"] for r in ordered.repartition(5).orderBy("o").collect()] == list(want)
                assert ordered.select("o").distinct().count() == len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    grouped = tables.with_order(df.groupBy("word").count(), "o")
    assert grouped.count() == 3 and dict(grouped.dtypes)["o"] == "bigint"
