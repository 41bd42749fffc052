"""The corpus pipeline: documents through five stages, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept. All but the last return the
columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bpe_codec, common, jaccard_join, line_dedup, mixing, toxicity


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, n_chars (where there is one) counted anew."""
    return out.select([F.coalesce(F.length("text"), F.lit(0)).cast(x.dataType).alias("n_chars") if x.name == "n_chars" else F.col(f"`{x.name}`") for x in docs.schema.fields])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.3 or more go. The labels' table is the training set."""
    return toxicity.keep(docs, toxicity.fit(docs, toxicity.training_labels(common.table(spark, sf_dir, "labels"))))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters and more that three documents share stay in one of them; no document goes."""
    return _like(docs, line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one of smallest id stays."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words stay, weighed by size to the power 0.9 at each level of domain, language and source, so that
    large sources give most of what goes. No document is repeated."""
    out = mixing.mix(docs, mixing.levels(), mixing.word_count(F.col("text")), share=0.9, power=0.9, max_epochs=1, seed="pipeline")
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    found = bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_codec", encode),
]

#: Nearest neighbours and byte-pair merges have no SQL; a brute-force version in tests/llm holds the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's scratch tables go when its output is written, and its input, too."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = common.Scratch(spark, f"pipeline-{name}")
        with common.scope():
            docs = written.put(stage(spark, docs, sf_dir))
        if before:
            before.drop(before.root)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
