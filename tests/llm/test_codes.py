import hashlib
import math
import random

import numpy as np
import pytest

from quarrylens.llm import vector_codes as V


def brute(rows, parts, entries, rounds, scale):
    """Full scans with Python's numbers: {row: (code, error)}, codebooks, label errors."""
    good = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(x * scale) for x in v] for _, v, _ in good]
    dim = len(ints[0])
    cut = lambda v, p: v[p * dim // parts : (p + 1) * dim // parts]
    first = sorted(range(len(good)), key=lambda j: (good[j][0] is None, good[j][0] or 0, good[j][1]))[:entries]
    books = [[list(cut(ints[j], p)) for j in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for v in ints]
    for _ in range(rounds):
        codes = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, c in zip(ints, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = near()
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(ints, codes, strict=True)]
    total = {}
    for (_, _, g), e in zip(good, errors, strict=True):
        total[g] = total.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{x:02x}" for x in c), e, total[g], digest) for (i, _, g), c, e in zip(good, codes, errors, strict=True))


def found(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


KIND = "vec_id long, embedding array<float>, label int, code string, error long"


@pytest.mark.parametrize("spread", [1.0, 0.01, 0.004])
def test_by_brute_force(spark, spread):
    """A small spread makes whole numbers of few values: many ties and equal entries."""
    r = random.Random(spread)
    single = lambda x: float(np.float32(x))
    rows = [(i * 7 % 151, [single(r.gauss(0, spread) + (i % 3) * spread) for _ in range(8)], None if i % 5 == 0 else i % 4) for i in range(151)]
    rows += [(500, None, 1), (501, [1.0, None, *[0.0] * 6], 1), (502, [float("nan")] * 8, 1), (503, [float("inf"), *[0.0] * 7], None), (None, [0.5] * 8, 2), rows[7], rows[7], (3, [0.25] * 8, 1)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], KIND).repartition(3)
    for parts, entries, rounds, scale in {1.0: ((4, 16, 4, 1024), (4, 256, 1, 1024)), 0.01: ((4, 16, 4, 1024), (4, 1, 1, 1024)), 0.004: ((2, 9, 3, 10), (4, 16, 0, 1024))}[spread]:
        assert found(V.compress(df, parts, entries, rounds, scale)) == brute(rows, parts, entries, rounds, scale)


def test_bounds_spare_scans(spark):
    r = random.Random(4)
    rows = [(i, [float(np.float32(10 * (i % 16) + r.random())) for _ in range(8)], 0, "", 0) for i in range(800)]
    scans = []
    got = found(V.compress(spark.createDataFrame(rows, KIND), entries=16, rounds=4, scans=scans))
    assert got == brute([x[:3] for x in rows], 4, 16, 4, 1024)
    assert scans[0] == 800 * 4 and len(scans) == 5 and max(scans[2:]) < 800


def test_large_components_are_exact(spark):
    r = random.Random(5)
    rows = [(i, [r.randint(-(2**31), 2**31) / 2 for _ in range(4)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(V.compress(df, entries=6, rounds=2, scale=1)) == brute(rows, 4, 6, 2, 1)
    with pytest.raises(Exception, match="components? times"):
        V.compress(spark.createDataFrame([(1, [1e300] * 4, 1)], df.schema))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 1, "x", 1), (2, [1.0] * 4, 1, "x", 1)], KIND)
    with pytest.raises(Exception, match="components"):
        V.compress(df).collect()
    with pytest.raises(ValueError, match="equal parts"):
        V.compress(df, parts=3)
    none = V.compress(df.limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert V.compress(df.where("vec_id is null")).count() == 0
