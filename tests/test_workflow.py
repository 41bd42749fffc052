import json

import pytest
from pyspark.sql import functions as F

from quarrylens.config import ProfileConfig, ValidationError, check, from_dict, json_schema
from quarrylens.plans import artifacts, evidence, report, workflow
from quarrylens.sources import tables
from quarrylens.streaming import profile


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    config = ProfileConfig(dataset_name="Loans | 2024", response_column="defaulted", id_columns=("account_id",), train_test_column="split", segment_columns=("region",), profile_depth="deep")
    return workflow.run(tables.sample_table(spark), config, export=True, base_dir=tmp_path_factory.mktemp("runs"))


def test_packet_and_files(result):
    assert evidence.check_packet(result.packet) == []
    files = {p.name for p in result.folder.iterdir()}
    assert len(files) == 16 and {"evidence_packet.json", "eda_report.html", "artifact_manifest.json", "plots"} <= files
    assert evidence.check_manifest(json.loads((result.folder / "artifact_manifest.json").read_text()), result.folder) == []
    assert result.packet["response_summary"]["positive_class"] == "1"
    assert [r["rank"] for r in result.packet["feature_ranking"]] == [1, 2, 3, 4]


def test_privacy(result):
    told = evidence.context(result.packet)
    assert evidence.check_context(told, ["A0001", "A0007"]) == []
    assert evidence.check_summary(evidence.summary(result.packet), result.packet) == []
    assert all(r["account_id"] == "<REDACTED>" for r in result.packet["dataset_overview"]["sample_rows"])
    assert evidence.check_summary({"referenced_columns": ["made_up"], "sample_rows": []}, result.packet)


def test_questions(result):
    ask = lambda q: evidence.answer(q, result.packet)
    assert ask("show rows of ids")["status"] == "blocked_raw_data" and ask(" ")["status"] == "empty_question"
    assert ask("is there leakage?")["evidence_sources"][0] == "leakage_warnings" and ask("nulls?")["evidence_sources"] == ["missingness_summary"]
    assert "drift_summary" in ask("any shift?")["evidence_sources"] and ask("model readiness")["evidence_sources"] == ["modeling_risk_summary"]


def test_column_search(result):
    assert [r["name"] for r in evidence.find_columns(result.packet, "IN")] == ["income"]
    assert {r["name"] for r in evidence.find_columns(result.packet, semantic_type="numeric_continuous")} == {"age", "income"}


def test_history_and_comparison(result, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "run_metadata.json").write_text("{")
    assert artifacts.history(tmp_path)[0]["status"] == "incomplete"
    assert artifacts.history(result.folder.parent)[0]["status"] == "available"
    other = json.loads(json.dumps(result.packet))
    other["dataset_overview"]["row_count"] += 5
    other["feature_ranking"] = other["feature_ranking"][1:]
    got = artifacts.compare(result.packet, other)
    assert got["row_count_delta"]["delta"] == 5 and len(got["top_feature_changes"]["removed_top_features"]) == 1
    assert artifacts._folder(tmp_path, "broken").name == "broken_001"


def test_columns_over_a_limit_are_named(spark):
    df = spark.range(30).select("id", *[(F.col("id") * F.lit(i) % 7).alias(f"n{i}") for i in range(6)], F.col("id").alias("copy"))
    config = ProfileConfig(max_correlation_columns=3, profile_depth="standard")
    pairs = workflow.pair_summary(df, config)
    assert pairs["correlation_columns_left_out"] == ["n2", "n3", "n4", "n5", "copy"] and pairs["comparison_columns_left_out"] == []
    assert {(p["left"], p["right"]) for p in pairs["possible_duplicate_columns"]} == {("id", "copy")}
    assert any("5 columns were over a limit" in c for c in workflow.caveats(config, {"available": False, "problem_type": "unsupervised"}, 5))


def test_report_escapes(result):
    assert "Loans \\| 2024" in result.markdown and result.markdown.count("\n## ") >= 16
    assert report.cell("a|b\n<c>") == "a\\|b &lt;c&gt;" and report.code("a`b") == "``a`b``"
    assert "<script>" not in report.as_html("<script>")


def test_csv(spark, tmp_path):
    path = tmp_path / "small.csv"
    path.write_text("id,amount,flag,day\n1,2.5,True,2024-01-01\n2,NA,False,2024-01-02\n,3,True,x\n")
    got = tables.load(spark, str(path))
    assert dict(got.frame.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "day": "string"} and got.rows == 3 and got.name == "small"
    for name, text in (("empty.csv", ""), ("header.csv", "a,b\n"), ("bad.txt", "a\n1\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValidationError):
            tables.load(spark, str(tmp_path / name))
    a, b = (tables.fingerprint(got.frame.repartition(n), "x") for n in (1, 3))
    assert a == b and len(a) == 12


@pytest.mark.parametrize("bad", [{"problem_type": "x"}, {"max_categories": 0}, {"max_categories": True}, {"rare_category_threshold": 1.5}, {"drift_warning_threshold": 0.9}, {"response_column": "nope"}, {"id_columns": ("a", "a")}, {"exclude_columns": ("a",), "response_column": "a"}, {"response_column": "a", "id_columns": ("a",)}, {"drift_fail_threshold": float("nan")}])
def test_bad_settings(spark, bad):
    with pytest.raises(ValidationError):
        check(spark.createDataFrame([(1,)], "a int"), ProfileConfig(**bad))


def test_settings_from_dict():
    assert from_dict({"id_columns": ["a"]}).id_columns == ("a",) and json_schema()["properties"]["max_categories"]["type"] == "integer"
    with pytest.raises(ValidationError):
        from_dict({"other": 1})


def test_odd_names_and_types(spark):
    df = spark.sql("select id as `a|b`, cast(id % 3 as string) as `c``d`, cast(id as decimal(10,2)) as dec, date'2024-01-01' as d, double('nan') as gone from range(25)")
    got = workflow.run(df, ProfileConfig(response_column="c`d"))
    kinds = {p["name"]: p["semantic_type"] for p in got.packet["column_type_summary"]["columns"]}
    assert kinds["gone"] == "all_missing" and kinds["d"] == "constant" and got.packet["response_summary"]["problem_type"] == "multiclass_classification"
    with pytest.raises(ValidationError):
        workflow.run(spark.sql("select array(1) as a"))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select id, if(id % 2 = 0, null, 'x') as s from range(10)").write.parquet(str(src))
    got = []
    stream = spark.readStream.schema("id bigint, s string").parquet(str(src))
    q = profile.profiled(stream, lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.missing_count for r in got if r.column == "s") == 5
