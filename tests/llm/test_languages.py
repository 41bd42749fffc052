import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import language_id as L


def brute_counts(texts, order):
    """n[context][byte] of all contexts of up to order bytes."""
    out = collections.defaultdict(collections.Counter)
    for t in texts:
        t = b" " * order + bytes(b + 32 if 65 <= b <= 90 else b for b in t)
        for i in range(order, len(t)):
            for k in range(order + 1):
                out[t[i - k : i]][t[i]] += 1
    return out


def brute_probability(n, context, byte):
    """Escapes one byte at a time, without what was seen before."""
    while context not in n:
        context = context[1:]
    p, excluded = 1.0, set()
    while True:
        here = {b: c for b, c in n[context].items() if b not in excluded}
        total, kinds = sum(here.values()), len(here)
        if not context and len(n[context]) == 256:
            kinds = 0
        if byte in here:
            return p * here[byte] / (total + kinds)
        if total:
            p *= kinds / (total + kinds)
        excluded |= set(here)
        if not context:
            return p / (256 - len(n[context]))
        context = context[1:]


def tree(texts, order, most=10**9):
    joined, starts, ends = L.padded(texts, order)
    codes = L.grams(joined, order)
    codes = np.concatenate([codes[a:b] for a, b in zip(starts, ends, strict=True)])
    found, n = np.unique(codes, return_counts=True)
    return L.Tree(found, n, order, most)


def code_of(context, byte, order):
    out = 0
    for b in (b"\0" * order + context)[-order:] + bytes([byte]):
        out = out << 8 | b
    return out


@pytest.mark.parametrize("order", [1, 3, 4, 6])
def test_probabilities_by_brute_force(order):
    r = random.Random(order)
    texts = [bytes(r.choice(b"abcAB \xc3\xa9\n") for _ in range(r.randint(0, 80))) for _ in range(30)]
    t, n = tree(texts, order), brute_counts(texts, order)
    for _ in range(60):
        context = bytes(r.choice(b"abc \xc3x") for _ in range(order))
        got = t.bits(np.array([code_of(context, b, order) for b in range(256)], np.uint64))
        want = [-math.log2(brute_probability(n, context, b)) for b in range(256)]
        assert np.allclose(got, want)
        assert math.isclose(np.exp2(-got).sum(), 1.0)


def test_every_byte_seen():
    t = tree([bytes(range(256)) * 3], 2)
    for context in (b"ab", b"zz", b"  "):
        assert math.isclose(np.exp2(-t.bits(np.array([code_of(context, b, 2) for b in range(256)], np.uint64))).sum(), 1.0)


def test_seldom_contexts_are_left_out():
    r = random.Random(5)
    texts = [bytes(r.choice(b"abcdefgh ") for _ in range(400)) for _ in range(5)]
    full, small = tree(texts, 4), tree(texts, 4, 500)
    assert len(small.entries) <= 500 + 256 < len(full.entries)
    for context in (b"abcd", b"  ab", b"zzzz"):
        assert math.isclose(np.exp2(-small.bits(np.array([code_of(context, b, 4) for b in range(256)], np.uint64))).sum(), 1.0)


def test_text_lengths_are_sums_at_any_window_and_slot(monkeypatch):
    r = random.Random(6)
    make = lambda letters: [bytes(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(20)]
    a, b = make(b"abc "), make(b"bcdXY ")
    texts = [*a[:5], b"", *b[:5], b"q" * 500, b"A", "é你".encode()]
    models = L.Models(["a", "b"], [tree(a, 3), tree(b, 3)], 3)
    want = []
    for t in texts:
        t = b" " * 3 + t.lower()
        codes = np.array([code_of(t[i - 3 : i], t[i], 3) for i in range(3, len(t))], np.uint64)
        want.append(models.lengths(codes).sum(0).tolist())
    for windows, slots in ((1 << 21, 1 << 20), (7, 1 << 20), (64, 4)):
        monkeypatch.setattr(L, "WINDOWS", windows)
        monkeypatch.setattr(L, "SLOTS", slots)
        models._keys = None
        for _ in range(2):
            assert models.text_lengths(texts).tolist() == want


def test_held_out_accuracy_and_frames(spark, no_docs):
    r = random.Random(8)
    syllables = {"aa": "the ing er on re".split(), "bb": "der sch ein ung ü".split(), "cc": "é que les ou è".split()}
    rows = []
    for i in range(300):
        lang = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(r.randint(1, 40))), lang if i % 17 else None, "s", i))
    truth = {i: list(syllables)[i % 3] for i in range(300)}
    rows += [(300, None, "aa", None, None), (301, "", "aa", "s", 1), (302, "123 ,.", "bb", "s", 1), (None, "theing onre", "aa", "s", 1), (303, "schein " * 20_000, None, "s", 1), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int").repartition(4)
    models = L.fit(docs, ~L.held_out(F.col("doc_id")))
    assert models.languages == ["aa", "bb", "cc"]
    got = L.predict(docs, models).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by_id[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held) > 40
    assert [by_id[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and [by_id[i].score for i in (300, 301, 302)] == [0.0] * 3
    assert by_id[303].lang_pred == "bb" and by_id[None].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got)
    assert sum(x.doc_id == 3 for x in got) == 3
    nothing = L.fit(docs, F.lit(False))
    assert nothing.languages == [] and {x.lang_pred for x in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(no_docs, L.fit(no_docs, F.lit(True))).count() == 0
    few = L.fit(docs, ~L.held_out(F.col("doc_id")), L.Settings(max_rows=5, max_bytes=300, max_entries=3000))
    assert sum(len(t.entries) for t in few.trees) <= 3000 + 3 * 256
    assert all(0 < int(t.n[t.entries < 512].sum()) < 2000 for t in few.trees)  # 300 bytes on average, one text at least


def test_the_language_column_does_not_sway(spark):
    rows = [(i, "the ring on there " * 3 if i % 2 else "der schein und über " * 3, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") < 40
    models = L.fit(docs, learn)
    turned = docs.withColumn("lang", F.when(F.col("doc_id") >= 40, "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, L.predict(turned, L.fit(turned, learn)).collect())) == sorted(map(tuple, L.predict(docs, models).collect()))
