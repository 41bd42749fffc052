"""The pipeline's stages on a small corpus with planted cases, each held against a plain version of itself."""

import collections
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarrylens.llm import queries

from .test_lines import key_of
from .test_models import toxic_rows
from .test_pairs import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    shared = "a passage that several of the documents hold word for word"
    rows = [(i, t + (f"\n{shared}" if i % 50 == 1 else ""), "en" if i % 3 else "de", f"src{i % 4}", len(t)) for i, t, _ in toxic_rows(1, 600)]
    rows += [(600 + i, rows[i][1] + " tail", "en", "src0", 9) for i in range(1, 40, 4)] + [(700, None, None, None, None), (701, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows(1, 600)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
        if name != "bpe_codec":
            assert docs.columns == before.columns
    before, after = seen["toxicity"]
    bad = re.compile("scoundrel|rotter|knav")
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not bad.search(r.text or "")}
    before, after = seen["line_dedup"]
    held = collections.defaultdict(set)
    for r in before:
        for line in (r.text or "").split("\n"):
            held[key_of(line)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if len(key_of(x)) < 20 or len(held[key_of(x)]) < 3 or max(held[key_of(x)]) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["jaccard_join"]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, root) in groups.items() if root == i} and len(after) < len(before)
    before, after = seen["mixing"]
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and 0.75 * words(before) < words(after) <= 0.9 * words(before) + 1
    before, after = seen["bpe_codec"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: list(r.ids) for r in after} == {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in before}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, corpus).collect()} == {r.doc_id: list(r.ids) for r in after}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)
