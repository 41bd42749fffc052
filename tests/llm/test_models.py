import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import common, lm_score, mixing, pii, toxicity


def low(t):
    return (t or "").encode().translate(common.LOWER).split() + [b" "]


def test_lm_base_and_passes(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for r in rows if not held(r.doc_id) for w in low(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), len(w := low(r.text)), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for r in rows)
    got = lm_score.score(odd_docs, ~lm_score.held_out(F.col("doc_id")))
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert {r.train_tokens for r in found} == {total} and all(math.isfinite(r.score) and r.score < 0 for r in found)
    tight = lm_score.Settings()
    tight.max_filter_mb = 1
    assert sorted(round(r.score, 6) for r in lm_score.score(odd_docs, ~lm_score.held_out(F.col("doc_id")), tight).collect()) == sorted(round(r.score, 6) for r in found)
    assert lm_score.score(no_docs, F.lit(True)).count() == 0
    assert {r.n_known for r in lm_score.score(odd_docs, F.lit(False)).collect()} == {0}


@pytest.mark.parametrize(("share", "filter_mb"), [(1000, 256), (20, 256), (20, 0)])
def test_lm_score_by_brute_force(spark, odd_docs, monkeypatch, share, filter_mb):
    """A plain dictionary model with the same levels; with 20, some words are frequent and dealt by both words; with 0, no filter
    is broadcast."""
    monkeypatch.setattr(lm_score, "FREQUENT_SHARE", share)
    monkeypatch.setattr(lm_score, "LEAST_FREQUENT", 5)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 500)
    r = random.Random(9)
    rows = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    rows += [(200 + i, " ".join(r.choice(["the", "Of", "and", *(f"w{j}" for j in range(40))]) for _ in range(r.randint(1, 60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    learns = lambda i: i is not None and i % 4 != 0
    s = lm_score.Settings(bits_per_entry=60.0, hashes=20, max_filter_mb=filter_mb)  # no probe finds what isn't there
    uni, pairs, sums = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if learns(i):
            uni.update(low(t))
            pairs.update(zip([b" ", *low(t)], low(t), strict=False))
    total, distinct = sum(uni.values()), len(uni)
    middle = lambda c: float(lm_score.dequantised(lm_score.quantised(np.array([c]), s.base).astype(float), s.base)[0]) if c else 0.0
    for (v, _), c in pairs.items():
        sums[v] += middle(c)
    p = lambda w: (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))
    given = lambda w, v: (middle(pairs[v, w]) + s.prior * p(w)) / (sums[v] + s.prior)
    for v in [*list(uni)[:40], b" ", b"unknown"]:
        assert abs(sum(given(w, v) for w in uni) + given(b"unknown", v) - 1) < 1e-9
    want = sorted((str(i), round(sum(math.log10(given(w, v)) for v, w in zip([b" ", *low(t)], low(t), strict=False)), 6)) for i, t in rows)
    got = lm_score.score(docs, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False)), s).collect()
    assert sorted((str(x.doc_id), round(x.score, 6)) for x in got) == want


def test_lm_beats_its_base(spark):
    r = random.Random(2)
    step = {w: r.sample(range(60), 3) for w in range(60)}
    rows = []
    for i in range(400):
        w, words = r.randrange(60), []
        for _ in range(60):
            words.append(f"w{w}")
            w = r.choice(step[w])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = lm_score.score(docs, F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > 0.8 * s[1]


def test_filter_levels():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 2**32, 5000, dtype=np.uint64))
    levels = lm_score.quantised(r.geometric(0.3, len(keys)), 1.5)
    bits = lm_score.segment(keys, levels, 9.0, 5)
    f = lm_score.Filter(bits, np.zeros(1, np.int64), np.array([len(bits)]), 5)
    got = f.levels(keys, np.zeros(len(keys), np.int64))
    assert (got >= levels).all() and (got == levels).mean() > 0.95  # never lower; seldom higher
    other = np.setdiff1d(r.integers(0, 2**32, 5000, dtype=np.uint64), keys)
    assert (f.levels(other, np.zeros(len(other), np.int64)) == 0).mean() > 0.95


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_by_brute_force():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab.@-+ 0123459()²٣_") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    for t in ("1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1 " * 50_000, "4111 1111 1111 1111"):
        pii.base_spans(t)


def test_crf_on_held_out_rows_and_frames(spark, odd_docs, no_docs):
    model = pii.train(pii.labelled_table())
    right = total = 0
    for words, states in pii.labelled_table(200, seed=99):
        got = model.decode([model.scores(pii._features(words))])[0]
        right, total = right + sum(int(a) == b for a, b in zip(got, states, strict=True)), total + len(states)
    assert right / total > 0.98
    best = np.argmax(model.scores(pii._features(["+1", "(415)", "555-0199"])), 1)
    assert len(best) == 3
    text = "call (415) 555-0199 or bob (at) acme (dot) com, a@b.co 10.0.0.1 id 123-45-6789 on 2024-01-02"
    found = pii.find_all([text], model)[0]
    assert [(text[a:b], k, base) for a, b, k, base in found] == [("(415) 555-0199", "phone", False), ("bob (at) acme (dot) com", "email", False), ("a@b.co", "email", True), ("10.0.0.1", "ip", True)]
    docs = odd_docs.unionByName(spark.createDataFrame([(99, text)], "doc_id long, text string"), allowMissingColumns=True)
    got = pii.find(docs, model)
    assert got.count() == docs.count() and {tuple(x) for r in got.where("doc_id = 99").collect() for x in r.spans} == {(k, a, b, z) for a, b, k, z in found}
    assert pii.redact(docs, model).where("doc_id = 99").first().text.startswith("call [phone] or [email], [email] [ip] id 123-45-6789")
    assert pii.find(no_docs, model).count() == 0
    # Viterbi in batches equals trying every path
    import itertools

    scores = model.scores(pii._features(["x", "415", "555", "0199"]))
    paths = list(itertools.product(range(5), repeat=4))
    value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))
    assert value(model.decode([scores])[0]) == max(map(value, paths))


def toxic_rows(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words, bad = [f"w{r.randrange(800)}" for _ in range(r.randint(5, 60))], i % 4 == 0
        words = ["".join(chr(97 + int(c)) for c in w[1:]) for w in words]
        if bad:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(["scoundrel", "rotter", "knavish", "knavery"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    df = spark.createDataFrame(toxic_rows(1, 600), "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    index = toxicity.fit(docs, toxicity.training_labels(labels))
    got = toxicity.score(docs, index).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and np.mean([(r.score >= 0.3) == r.toxic for r in got]) > 0.97
    assert all(0 <= r.score <= 1 and len(r.similar) == len(r.cosines) == len(r.labels) for r in got)
    # the index finds what all products find
    v = index.vectors([r.text.encode() for r in docs.limit(60).collect()])
    full = np.zeros((len(index.toxic), len(index.terms) + 1))
    for t in range(len(index.terms) + 1):
        lo, hi = index.blocks[t, 0], index.blocks[t, -1]
        full[index.rows[lo:hi], t] = index.weights[lo:hi]
    for terms, w in v:
        if len(terms):
            sims = np.round(full[:, terms] @ w, 9)
            rows, found = index.nearest(terms, w)
            assert np.allclose(found, np.sort(sims)[::-1][: len(found)]) and len(rows) == min(index.k, (sims > 0).sum())
    assert toxicity.score(odd_docs, index).count() == odd_docs.count()
    kept = toxicity.keep(odd_docs, index)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.score(no_docs, index).count() == 0
    empty = toxicity.fit(docs.limit(0), labels)
    assert {r.score for r in toxicity.score(odd_docs, empty).collect()} == {0.0}


def plain_terms(text):
    """A text's terms in plain Python: small words and their first 4 and 5 bytes."""
    words = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in text.encode()).split(b" ")
    return collections.Counter(x for w in words if w for x in [(0, w), *((n, w[:n]) for n in (4, 5) if len(w) >= n)])


def plain_cosines(examples, asked):
    """Cosines of TF-IDF vectors over all terms, in plain Python."""
    held = collections.Counter(t for e in examples for t in plain_terms(e))

    def vector(text):
        v = {t: n * (math.log((1 + len(examples)) / (1 + held[t])) + 1) for t, n in plain_terms(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [vector(e) for e in examples]
    return [[sum(x * v.get(t, 0) for t, x in vector(a).items()) for v in vectors] for a in asked]


@pytest.mark.parametrize("block", [64, 3])
def test_toxicity_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    few = [word() for _ in range(12)]
    rows = [(i, " ".join(["usual", *(r.choice(few) if r.random() < 0.5 else word() for _ in range(r.randint(1, 30))), *["Rotter!"] * (i % 5 == 0) * (i % 3)])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")), k=4)
    texts, labels = [t for _, t in rows], [int(i % 5 == 0) for i, _ in rows]
    assert len(index.terms) == len({t for x in texts for t in plain_terms(x)})  # what one example alone holds is a term too
    asked = [*texts[:20], texts[3] + " never seen before", texts[4] * 3 + texts[5], "rotter usual", "zzzz"]

    def vote(sims):
        best = [i for i in sorted(range(len(sims)), key=lambda i: -sims[i])[:4] if sims[i] > 0]
        w = {i: 1 / (0.1 + math.sqrt(max(0, 2 - 2 * sims[i]))) for i in best}
        return best, sum(w[i] * labels[i] for i in best) / sum(w.values()) if best else None

    own = [vote([s if j != i else 0 for j, s in enumerate(sims)])[1] for i, sims in enumerate(plain_cosines(texts, texts))]
    raws = sorted(set(own))
    mean = lambda a, b: (lambda ys: sum(ys) / len(ys))([y for v, y in zip(own, labels, strict=True) if raws[a] <= v <= raws[b]])
    level = [max(min(mean(a, b) for b in range(i, len(raws))) for a in range(i + 1)) for i in range(len(raws))]  # isotonic regression
    for sims, (score, found, cosines) in zip(plain_cosines(texts, asked), index.scores([a.encode() for a in asked]), strict=True):
        best, raw = vote(sims)
        assert len(found) == len(best) and np.allclose(cosines, [sims[i] for i in best], atol=1e-6)
        assert sorted(index.toxic[found].tolist()) == sorted(labels[i] for i in best) or len({round(sims[i], 6) for i in best}) < len(best)
        want = index.none if raw is None else level[min(range(len(raws)), key=lambda i: (abs(raws[i] - raw), i))]
        assert abs(score - want) < 1e-6


@pytest.mark.parametrize("directions", [1, 32])
def test_toxicity_makes_matrices_by_block(spark, monkeypatch, directions):
    monkeypatch.setattr(toxicity, "DIRECTIONS", directions)
    monkeypatch.setattr(toxicity, "DENSE_SHARE", 0.005)
    rows = toxic_rows(3, 600)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    sent = index.for_workers()
    assert len(sent.rows) + len(sent.frequent.ids) == len(index.rows)  # no posting is sent twice
    held, asked = sent.holding(), sent.vectors([t.encode() for _, t, _ in rows[:12]])
    tracemalloc.start()
    built = list(sent.all_nearest(asked))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < held.held.nbytes / 2
    full = np.zeros((len(index.toxic), len(index.terms) + 1))
    for t, (lo, hi) in enumerate(index.blocks.tolist()):
        full[index.rows[lo:hi], t] = index.weights[lo:hi]
    assert np.allclose((full**2).sum(1), 1)
    for (terms, w), a, b in zip(asked, built, held.all_nearest(asked), strict=True):
        sims = np.round(full[:, terms] @ w, 9)
        want = np.lexsort((index.hashes, -sims))[: index.k]
        assert a[0].tolist() == b[0].tolist() == want.tolist() and np.allclose(a[1], sims[want], atol=2e-9) and np.allclose(a[1], b[1], atol=2e-9)


def test_budgets():
    assert mixing.fill([1, 1, 2], [10, 100, 1000], 100) == [10, 30, 60]
    assert mixing.fill([1, 1], [3, 3], 100) == [3, 3] and mixing.fill([1, 1, 1], [50, 50, 50], 100) == [34, 33, 33] and mixing.fill([0, 1], [9, 9], 5) == [0, 5]
    leaves = [(("a", "x"), 10), (("a", "y"), 100), (("b", "z"), 1000)]
    got = {p: b for p, _, b in mixing.plan(mixing.tree(leaves, {("a",): 1, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1}), 100, 1)}
    assert got == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}  # a sibling takes what x can't
    got = {p: b for p, _, b in mixing.plan(mixing.tree(leaves, {("a",): 9, ("b",): 1}), 500, 1)}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 390}  # what the family can't take goes up


def test_default_weights_are_on_the_scale_of_given_ones():
    leaves = [(("a",), 1000), (("b",), 1000), (("other",), 1000)]
    root = mixing.tree(leaves, {("a",): 0.25, ("b",): 0.75})
    assert [c.weight for c in root.children] == [0.25, 0.75, 0.5]
    budgets = {p: b for p, _, b in mixing.plan(root, 900, 2)}
    assert budgets[("a",)] * 3 - budgets[("b",)] in range(-3, 4) and budgets[("other",)] in range(299, 302)
    assert [c.weight for c in mixing.tree(leaves, None, 0.5).children] == [1000**0.5] * 3


def plain_budgets(leaves, weights, power, budget, epochs):
    """Budgets by exact fractions: each family's level of filling is found among the points where a member is full."""
    from fractions import Fraction

    def room(prefix):
        return sum(n * epochs for p, n in leaves.items() if p[: len(prefix)] == prefix)

    out = {}

    def share(prefix, left):
        if prefix in leaves:
            out[prefix] = left
            return
        kids = sorted({p[: len(prefix) + 1] for p in leaves if p[: len(prefix)] == prefix}, key=lambda p: tuple("" if x is None else x for x in p))
        size = {k: sum(n for p, n in leaves.items() if p[: len(k)] == k) for k in kids}
        w = {k: Fraction(weights[k] if k in weights else size[k] ** power) for k in kids}
        rooms = {k: room(k) for k in kids}
        left = min(left, sum(rooms[k] for k in kids if w[k]))
        got = {k: 0 for k in kids}
        full = lambda level: sum(min(Fraction(rooms[k]), level * w[k]) for k in kids)
        points = sorted(Fraction(rooms[k]) / w[k] for k in kids if w[k])
        if points:
            low = max([x for x in points if full(x) <= left], default=Fraction(0))
            live = sum(w[k] for k in kids if w[k] and Fraction(rooms[k]) / w[k] > low)
            level = low + (left - full(low)) / live if live else low
            got = {k: min(rooms[k], int(level * w[k])) for k in kids}
        for k in kids:  # what rounding leaves goes to the first with room
            more = min(left - sum(got.values()), rooms[k] - got[k]) if w[k] else 0
            got[k] += more
        for k in kids:
            share(k, got[k])

    share((), budget)
    return out


@pytest.mark.parametrize(("power", "weights", "epochs", "part"), [(1, {}, 3, 0.9), (0, {("en",): 3, ("de",): 1, (None,): 2}, 2, 1.1), (2, {("en", "src1"): 5, ("en", "src2"): 0}, 1, 0.5)])
def test_mix_by_plain_budgets(spark, odd_docs, power, weights, epochs, part):
    """Against budgets and prefixes that share no code with the module; extra columns are named like its own."""
    tokens = mixing.word_count(F.col("text"))
    docs = odd_docs.withColumn("__leaf", F.lit(1)).withColumn("__tokens", F.lit("x")).withColumn("__LEVEL0", F.lit(2))
    rows = [(x.doc_id, (x.lang, x.source), len((x.text or "").split())) for x in docs.collect()]
    leaf = collections.defaultdict(list)
    for d, path, n in rows:
        leaf[path].append((d, n))
    totals = {k: sum(n for _, n in v) for k, v in leaf.items()}
    default = {}
    for depth in (1, 2):  # unnamed siblings weigh on the scale of named ones
        for p in {k[:depth] for k in totals}:
            kin = {k[:depth] for k in totals if k[: depth - 1] == p[:-1]}
            size = lambda q: sum(n for k, n in totals.items() if k[: len(q)] == q)
            named = [q for q in kin if q in weights]
            scale = sum(weights[q] for q in named) / sum(size(q) ** power for q in named) if named and sum(size(q) ** power for q in named) and sum(weights[q] for q in named) else 1
            default[p] = weights[p] if p in weights else size(p) ** power * scale
    budgets = plain_budgets(totals, default, power, int(sum(totals.values()) * part), epochs)
    want = collections.Counter()
    for path, docs_of in leaf.items():
        full, rest = divmod(budgets[path], totals[path]) if totals[path] else (0, 0)
        want.update((d, e) for d, _ in docs_of for e in range(full))
        done = 0
        for _, d, n in sorted((hashlib.md5(f"z:{full}:{'' if d is None else d}".encode()).hexdigest(), d, n) for d, n in docs_of) if rest else []:
            done += n
            if done > rest:
                break
            want[d, full] += 1
    out = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, tokens, share=part, weights=weights, power=power, max_epochs=epochs, seed="z")
    assert collections.Counter((x.doc_id, x.epoch) for x in out.collect()) == want
    assert out.columns == [c for c in docs.columns if c != "epoch"] + ["epoch"]


def test_mix_by_brute_force(spark, odd_docs, no_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    tokens = mixing.word_count(F.col("text"))
    rows = odd_docs.select("doc_id", "lang", "source", tokens.alias("n")).collect()
    leaf = collections.defaultdict(list)
    for r in rows:
        leaf[(r.lang, r.source)].append((r.doc_id, r.n))
    root = mixing.tree([(k, sum(n for _, n in v)) for k, v in leaf.items()], None, 0.5)
    want = collections.Counter()
    for path, total, budget in mixing.plan(root, int(root.tokens * 0.9), 3):
        full, rest = divmod(budget, total) if total else (0, 0)
        for e in range(full):
            want.update((d, e) for d, _ in leaf[path])
        done = 0
        for _, d, n in sorted((hashlib.md5(f"s:{full}:{'' if d is None else d}".encode()).hexdigest(), d, n) for d, n in leaf[path]) if rest else []:
            done += n
            if done > rest:
                break
            want[d, full] += 1
    out = mixing.mix(odd_docs, levels, tokens, share=0.9, power=0.5, max_epochs=3, seed="s")
    assert collections.Counter((r.doc_id, r.epoch) for r in out.collect()) == want
    assert out.columns == [c for c in odd_docs.columns if c != "epoch"] + ["epoch"]
    assert mixing.mix(no_docs, levels, tokens).count() == 0
