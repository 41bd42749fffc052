import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import exact_topk, jaccard_join


def brute_groups(docs, n, percent):
    """doc -> (set size, smallest id reachable)."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed, count=30):
    r = random.Random(seed)
    vocabulary, docs, i = [f"w{k}" for k in range(120)], [], 0
    passage = [r.choice(vocabulary) for _ in range(50)]
    for _ in range(count):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 9, 10, 11, 14, 20, 40, 120, 300]))]
        if r.random() < 0.3:
            base += passage
        for _ in range(r.randint(1, 8)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 20))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append((i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
            i += 1
    return docs + [(i, None), (i + 1, ""), (i + 2, " \n")]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 70, 3)])
def test_groups_by_brute_force(spark, n, percent, seed):
    docs = families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()}
    assert got == brute_groups(docs, n, percent)


def test_hot_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_IN_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    r = random.Random(8)
    base = [f"v{k}" for k in range(60)]
    docs = []
    for i in range(60):  # a chain of drifting copies: neighbours link, the ends do not
        base[r.randrange(60)] = f"z{i}"
        docs.append((i, " ".join(base)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute_groups(docs, 3, 90)


def test_bounds_never_lose_a_link():
    r = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(r.integers(0, 2**63, r.integers(5, 200), dtype=np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(0, 2**63, r.integers(0, 9), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert jaccard_join.links(x, y, 90) == (both > 0 and 100 * both >= 90 * (len(x) + len(y) - both))
        if jaccard_join.links(x, y, 90):
            assert jaccard_join.may_link(len(x), jaccard_join.bitmap(x, 90), len(y), jaccard_join.bitmap(y, 90), 90)
            bits = [np.frombuffer(jaccard_join.sketch(z), np.uint8) for z in (x, y)]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= jaccard_join.most_apart(len(x), len(y), 90)
            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            assert np.intersect1d(jaccard_join.tile_keys(x, 90, none), jaccard_join.tile_keys(y, 90, none)).size


def test_odd_rows(odd_docs, no_docs):
    got = jaccard_join.groups(odd_docs, 3, 90)
    assert got.count() == odd_docs.count()
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add(r.component_id)
    assert by[60] == {60} and by[61] == {61} and by[62] == {62} and by[8] == {8}
    assert jaccard_join.groups(no_docs).count() == 0
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and {60, 61, 62, 8} <= {r.doc_id for r in kept.collect()}


def test_top_k_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [float(r.randint(-3, 3)) / 8 for _ in range(4)], 1) for i in range(300)]  # many ties
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [float("nan"), 0.0, 0.0, 0.0], 1), (303, [], 1), (304, [float("inf")] * 4, 1), (305, [9.0] * 5, 1), (None, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(5)
    queries = df.where("vec_id % 20 = 0")
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows[:300]]
    want = []
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:7], 1)]
    got = [tuple(x) for x in exact_topk.top_k(queries, df, k=7).collect()]
    assert sorted(got) == sorted(want)
    few = exact_topk.top_k(df.where("vec_id < 3"), df.where("vec_id < 3"), k=7).collect()
    assert len(few) == 6
    assert exact_topk.top_k(queries.limit(0), df).count() == exact_topk.top_k(queries, df.limit(0)).count() == 0
    big = spark.createDataFrame([(i, [float(2**23 + i), -float(2**20 * i)]) for i in range(6)], "vec_id long, embedding array<double>")
    q = {i: [64 * (2**23 + i), -64 * 2**20 * i] for i in range(6)}
    got = {(x.query_id, x.vec_id): x.score for x in exact_topk.top_k(big, big, k=9).collect()}
    assert got == {(a, b): sum(s * t for s, t in zip(q[a], q[b], strict=True)) for a in q for b in q if a != b}


def brute_top(vectors, queries, k):
    """Whole numbers of any size: (query, rank, id, score)."""
    whole = {i: [math.floor(x * 64) if abs(x) < 2**40 else int(x) * 64 for x in v] for i, v in vectors}
    out = []
    for q in queries:
        found = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_keeps_every_finite_vector(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATE_ROWS", 7)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 5)
    monkeypatch.setattr(exact_topk, "TILE_BLOCKS", 1)
    monkeypatch.setattr(exact_topk, "SUMMED", 2)
    r = random.Random(4)
    rows = [(0, [1.0, 2.0]), (1, [1e9, 1.0]), (2, [0.5, 0.5]), (3, []), (4, []), (5, [3.0]), (6, [1e-300, -1e-300]), (7, [2.0**56, -(2.0**56)])]
    rows += [(8 + i, [r.choice([1.0, 1e3, 1e6]) * r.uniform(-1, 1) for _ in range(2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    few = [0, 1, 2, 3, 5, 6, 20, 33, 40]
    got = exact_topk.top_k(df.where(F.col("vec_id").isin(few) & (F.col("vec_id") != 7)), df.where("vec_id <> 7"), k=6).collect()
    assert sorted(map(tuple, got)) == brute_top([x for x in rows if x[0] != 7], few, 6)
    # a vector of any size meets those with which its scores fit
    got = exact_topk.top_k(df.where("vec_id = 7"), df.where("vec_id in (2, 6)"), k=6).collect()
    assert sorted(map(tuple, got)) == brute_top([x for x in rows if x[0] in (2, 6, 7)], [7], 6)
    with pytest.raises(Exception, match="does not fit a long"):
        exact_topk.top_k(df.where("vec_id = 7"), df.where("vec_id in (1, 7)"), k=6).collect()


def test_buckets_by_exploded_rows(spark):
    large = spark.createDataFrame([(i, 20_000, 20) for i in range(60)], "tile long, n long, chunks long")
    rows = 60 * 20_000 * 20
    assert rows / jaccard_join._buckets(large) <= jaccard_join.BUCKET_ROWS
    assert jaccard_join._buckets(large.limit(0)) == 1
    small = spark.createDataFrame([(i, 2, 1) for i in range(9000)], "tile long, n long, chunks long")
    assert jaccard_join._buckets(small) == 5


def test_sets_come_the_same_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame(families(7), "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.groups(docs, 3, 90).collect()))
    monkeypatch.setattr(jaccard_join, "TOLD_NODES", 1)
    assert sorted(map(tuple, jaccard_join.groups(docs, 3, 90).collect())) == want


def _near_misses(count, size, shared, seed):
    """Sets of one family that share so many elements, and differ in all others."""
    r = np.random.default_rng(seed)
    core = np.unique(r.integers(0, 2**63, shared, dtype=np.uint64))
    return [np.unique(np.concatenate([core, r.integers(0, 2**63, size - len(core), dtype=np.uint64)])) for _ in range(count)]


def _tile(sets, percent, **more):
    import pyarrow as pa

    n = len(sets)
    table = {"tile": [7] * n, "upper": [False] * n, "same": [True] * n, "x": list(range(n)), "size": [len(s) for s in sets], "root": list(range(n)), "map": [jaccard_join.bitmap(s, percent) for s in sets]} | more
    return jaccard_join._open_tiles(pa.table(table), percent)


@pytest.mark.parametrize(("size", "percent", "shared"), [(300, 90, 0.87), (2000, 90, 0.86), (600, 80, 0.77), (2000, 80, 0.78)])
def test_opened_tiles_let_no_near_misses_out(size, percent, shared):
    """Jaccard similarities of 0.75 to 0.77 at 0.9, and of 0.63 at 0.8: of 44,850 pairs next to none is a row."""
    sets = _near_misses(300, size, int(size * shared), size)
    pairs = _tile(sets, percent)
    assert pairs.num_rows <= 45
    x, y = np.array(pairs["x"]), np.array(pairs["y"])
    assert (x > y).all()


def test_opened_tiles_keep_every_link(monkeypatch):
    """Sets of very different sizes, whose bitmaps have different lengths, in whole tiles and between two cuts of one."""
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 100)
    r = np.random.default_rng(5)
    for percent in (70, 80, 90):
        sets = []
        for size in (20, 70, 110, 160, 240, 300, 420, 600):
            base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            sets += [base] + [np.unique(np.concatenate([base[r.random(len(base)) < keep], r.integers(0, 2**63, 3, dtype=np.uint64)])) for keep in (0.99, 0.9, 0.8, 0.75)]
        want = {(j, i) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard_join.links(sets[i], sets[j], percent)}
        got = set(zip(*(_tile(sets, percent)[c].to_pylist() for c in "xy"), strict=True))
        assert want and want <= got
        upper = [i % 3 == 0 for i in range(len(sets))]
        cut = set(zip(*(_tile(sets, percent, same=[False] * len(sets), upper=upper)[c].to_pylist() for c in "xy"), strict=True))
        assert cut == {(x, y) for x, y in got if upper[x] != upper[y]}
        roots = [i // 5 for i in range(len(sets))]
        assert not any(roots[x] == roots[y] for x, y in zip(*(_tile(sets, percent, root=roots)[c].to_pylist() for c in "xy"), strict=True))


def test_tiles_of_the_same_members_are_opened_once(spark, monkeypatch):
    """Three texts that share a passage, none of them similar: many tiles hold the same three."""
    r = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [(i, passage + " " + " ".join(f"w{i}_{r.randrange(10**6)}" for _ in range(40))) for i in range(12)]
    seen = []
    real = jaccard_join._buckets
    monkeypatch.setattr(jaccard_join, "_buckets", lambda mixed: seen.append(mixed.collect()) or real(mixed))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute_groups(docs, 3, 90)
    (opened,) = seen
    assert all(r.n > 2 for r in opened) and len(opened) < 40  # of a tile for each element of twelve prefixes in two bands
