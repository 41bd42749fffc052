import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import bpe_codec, common, jaccard_join, line_dedup, lm_score, mixing, pii, quality_rules, token_counts


def test_word_hashes_by_plain_split():
    r = random.Random(1)
    texts = ["".join(r.choice("ab é\n\t0123456789xyz ") for _ in range(r.randint(0, 200))).encode() for _ in range(400)] + [b"", b" ", b"x" * 5000, b"y" * 4999 + b"z", b"y" * 4999 + b"w"]
    h, offsets, starts, ends = common.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    joined = b" ".join(texts)
    assert [joined[a:b] for a, b in zip(starts, ends, strict=True)] == words
    assert offsets.tolist() == [sum(len(t.split()) for t in texts[:i]) for i in range(len(texts) + 1)]
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(of.values())) == len(of)
    assert len(common.word_hashes([])[0]) == len(common.word_hashes([b""])[0]) == 0


def test_hashes_do_not_follow_from_sums():
    """Words of equal sums of weighted letters, which a polynomial modulo 2 to the 64 can't tell apart."""
    a, b = b"a" * 2048, b"a" * 2048
    for n in range(11):  # the Thue-Morse words of 2048 letters have one polynomial hash for every odd base
        a, b = (a, b) if n else (b"a", b"b")
        a, b = a + b, b + a
    h = common.word_hashes([a, b])[0]
    assert len(a) == 2048 and h[0] != h[1]


def test_names_that_are_free(spark):
    df = spark.range(1).select(F.lit(1).alias("__X"), F.lit(1).alias("y"))
    assert common.fresh(df, "x", "x", "y") == ["__x_", "__x__", "__y"]


def test_tables_of_a_scope_go(spark):
    with common.scope():
        scratch = common.Scratch(spark, "gone")
        scratch.put(spark.range(3))
        assert os.path.isdir(scratch.root.removeprefix("file://"))
    assert not os.path.exists(scratch.root.removeprefix("file://"))


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_bytes_that_are_not_utf8(spark):
    line = "a line that is held by all of the documents"
    broken = F.concat(F.unhex(F.lit("FF41")), F.encode(F.lit(f"b\n{line}\nmail a@b.co"), "utf-8")).cast("string")
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, broken).otherwise(F.lit(f"x\n{line}")).alias("text"), F.lit("h").alias("source"))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: "x", 1: "�Ab\nmail a@b.co", 2: "x", 3: f"x\n{line}"}
    assert {r.doc_id: len(r.spans) for r in pii.find(docs, pii.Model(*pii_weights())).collect()}[1] == 1
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.doc_id: r.decoded for r in bpe_codec.encode(docs, path, decoded=True).collect()}[1].startswith("�Ab\n")
    assert token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 4
    assert jaccard_join.groups(docs).count() == lm_score.score(docs, F.lit(True)).count() == quality_rules.verdicts(docs, F.col("source"))[0].count() == 4
    assert mixing.mix(docs, {"source": F.col("source")}, mixing.word_count(F.col("text"))).count() == 4


def pii_weights():
    import numpy as np

    return np.zeros((pii.FEATURES, len(pii.STATES))), np.zeros((len(pii.STATES), len(pii.STATES)))


def test_models_that_rewrite_text_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.pieces.add(piece="<mine>", score=0.0, type=proto.SentencePiece.USER_DEFINED)
    (tmp_path / "own.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="user-defined"):
        token_counts.prove(str(tmp_path / "own.model"))


def test_broken_bytes_are_redacted_and_cleaned(spark):
    """Bytes that are not UTF-8 end no job, in texts that change and in texts that don't."""
    from quarrylens.llm import pii, quality_rules

    docs = spark.sql("""select id as doc_id, 'h' as source, cast(concat(X'FF41', cast(concat(' write to a', id, '@example.org now\\n', array_join(transform(sequence(1, 40), k -> concat('w', k, 'of', id)), ' '), '\\nThe same long line is in every document of this host.') as binary)) as string) as text from range(40)
      union all select 40, 'h', null""")
    out = {r.doc_id: r.text for r in pii.redact(docs, pii.train(pii.labelled_table())).collect()}
    assert out[40] is None and all("[email]" in out[i] and "�A" in out[i] for i in range(40))
    kept = quality_rules.clean(docs, "source").withColumn("text", F.col("text").cast("binary")).collect()
    assert kept and all(bytes(r.text).decode(errors="replace").startswith("�A") for r in kept)


def test_a_worker_holds_one_model():
    made = []
    get = lambda name: common.model(name, lambda: made.append(name) or [name])
    first = get(("a", 1))
    assert get(("a", 1)) is first
    common.drop_model(("a", 1))
    assert get(("a", 1)) is first and made == [("a", 1)]
    get(("b", 1))
    assert list(common._MODEL) == [("b", 1)]
    common.drop_model()
    assert not common._MODEL
    get(("a", 1))
    assert made == [("a", 1), ("b", 1), ("a", 1)]
    common.drop_model(("b", 1))
    assert not common._MODEL


def test_pieces_of_a_task_are_as_small_as_asked_for(spark):
    df = spark.createDataFrame([("x" * 100,)] * 40, "t string").coalesce(1)
    rows = lambda **k: [r["n"] for r in common.over_batches(df, lambda: lambda piece: [[piece.num_rows]], "n long", "t", **k).collect()]
    assert rows() == [40] and rows(piece_bytes=1000) == [10] * 4


def held_by_workers(spark) -> int:
    """Codecs and indexes with a matrix in the workers that are there."""

    def count(batches):
        import gc

        for b in batches:
            yield b.assign(id=sum(type(x).__name__ == "Codec" or (type(x).__name__ == "Index" and "_dense" in x.__dict__) for x in gc.get_objects()))

    return sum(r["id"] for r in spark.range(0, 8, 1, 8).mapInPandas(count, "id long").collect())


def test_workers_wait_without_what_a_task_needed(spark):
    from quarrylens.llm import toxicity

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of number "), F.col("id").cast("string")).alias("text"))
    index = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert toxicity.score(docs, index).count() == 40 and held_by_workers(spark) == 0
    toxicity.keep(docs, index).collect()
    assert held_by_workers(spark) == 0
    assert len(bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()) == 40 and held_by_workers(spark) == 0


def test_workers_wait_without_matrices_of_toxicity(spark):
    from quarrylens.llm import toxicity

    def count(batches):
        import gc

        for b in batches:
            yield b.assign(id=sum(type(x).__name__ == "Index" and getattr(x, "held", None) is not None for x in gc.get_objects()))

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of number "), F.col("id").cast("string")).alias("text"))
    index = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert toxicity.score(docs, index).count() == 40 and toxicity.keep(docs, index).count() <= 40
    assert sum(r["id"] for r in spark.range(0, 8, 1, 8).mapInPandas(count, "id long").collect()) == 0


def test_batches_of_long_texts_are_small(spark):
    docs = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    got = common.over_batches(docs, lambda: lambda piece: [[piece.num_rows]], "n long", "t", piece_bytes=1 << 30).collect()
    assert sum(r["n"] for r in got) == 120 and max(r["n"] for r in got) <= 45
