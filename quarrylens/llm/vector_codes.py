"""Product codes of vectors: codebooks by Lloyd's rounds in whole numbers, with Hamerly's bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors of one row of the state, and vectors whose sums are added up before they are sent on (sums fit a long by this).
BLOCK, SUMMED = 4096, 1 << 20
#: Whole numbers of the vectors are below this, so that SUMMED of them fit a long.
LARGEST = 1 << 42


def finite(v: F.Column) -> F.Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error where that is no number that the sums can hold."""
    out = np.floor(vectors * float(scale))
    if not (np.abs(out) < LARGEST).all():
        raise OverflowError(f"a component times {scale} is {LARGEST} or more")
    return out.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x from every entry: as doubles where none can be inexact, else as Python's
    whole numbers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.stack([((x.astype(object) - e.astype(object)) ** 2).sum(1) for e in book], 1)


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows side by side."""
    most = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        d = (x - y).astype(np.float64)
        return np.einsum("ij,ij->i", d, d)
    return ((x.astype(object) - y.astype(object)) ** 2).sum(1) if len(x) else np.zeros(0)


def _above(x: np.ndarray) -> np.ndarray:
    """Single precision, no less than x."""
    return np.nextafter((np.asarray(x, np.float64) * (1 + 2.0**-40)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((np.asarray(x, np.float64) * (1 - 2.0**-40)).astype(np.float32), np.float32(-np.inf))


class Round:
    """What a round needs of the codebooks: the entries, how far each has moved since the last round at most, and half the
    distance to its nearest neighbour at least."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None):
        self.books = books
        parts, entries = books.shape[:2]
        self.moved = np.zeros((parts, entries)) if before is None else np.stack([_above(np.sqrt(_paired(a, b).astype(np.float64))).astype(np.float64) for a, b in zip(books, before, strict=True)])
        self.half = np.zeros((parts, entries))
        for p in range(parts):
            if entries > 1:
                d = distances(books[p], books[p]).astype(np.float64)
                np.fill_diagonal(d, np.inf)
                self.half[p] = _below(np.sqrt(d.min(1)) / 2)

    def assign(self, x: np.ndarray, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Sets code, upper and lower to the nearest entries and bounds of a part; returns how many rows were scanned in full.

        upper is no less than the distance from the own entry, lower no more than that from any other one. Entries have moved, so
        upper grows by the own entry's move and lower shrinks by the largest other one's. Where upper is strictly under
        lower, or under half of the distance from the own entry to any other, no other entry is as near: equal
        distances are always scanned, and the lower index wins."""
        book, moved, half = self.books[part], self.moved[part], self.half[part]
        own = code.astype(np.int64)
        if len(book) > 1:
            order = np.argsort(-moved, kind="stable")
            others = np.where(own == order[0], moved[order[1]], moved[order[0]])
        else:
            others = np.zeros(len(x))
        upper[:] = _above(upper.astype(np.float64) + moved[own])
        lower[:] = _below(lower.astype(np.float64) - others)
        limit = np.maximum(lower.astype(np.float64), half[own])
        at = np.flatnonzero(~(upper < limit))
        if len(at):  # the exact distance from the own entry first
            exact = np.isfinite(upper[at])
            near = at[exact]
            upper[near] = _above(np.sqrt(_paired(x[near], book[own[near]]).astype(np.float64)))
            at = at[~(upper[at] < limit[at])]
        if len(at):
            d = distances(x[at], book)
            best = np.argmin(d, 1)
            rows = np.arange(len(at))
            code[at] = best
            upper[at] = _above(np.sqrt(d[rows, best].astype(np.float64)))
            d = d.astype(np.float64)
            d[rows, best] = np.inf
            lower[at] = _below(np.sqrt(d.min(1)))
        return len(at)


def _blocks(rows: DataFrame, dim: int, parts: int, scale: int, kind: str) -> DataFrame:
    """The state before the first round: blocks of vectors in whole numbers, with bounds that tell nothing."""

    def run(batches):
        common.lean()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                b = batch.slice(start, BLOCK)
                sizes = set(common.column(b, "v").value_lengths().to_pylist())
                if sizes != {dim}:
                    raise ValueError(f"vectors of {sorted(sizes - {dim})} components among those of {dim}")
                x = whole(np.array(common.column(b, "v").flatten(), np.float64).reshape(b.num_rows, dim), scale)
                small = "<i2" if np.abs(x).max(initial=0) < 2**15 else "<i8"
                n = b.num_rows * parts
                yield pa.RecordBatch.from_arrays([
                    pa.array([common.column(b, "k").to_pylist()], pa.list_(common.column(b, "k").type)), pa.array([common.column(b, "of").to_pylist()], pa.list_(common.column(b, "of").type)), pa.array([small]), pa.array([common.packed(x.astype(small).ravel())]),
                    pa.array([np.zeros(n, "<i4").tobytes()]), pa.array([np.full(n, np.inf, "<f4").tobytes()]), pa.array([np.zeros(n, "<f4").tobytes()]),
                ], ["ids", "of", "size", "x", "codes", "upper", "lower"])

    return rows.mapInArrow(run, f"ids array<{kind.split('|')[0]}>, of array<{kind.split('|')[1]}>, size string, x binary, codes binary, upper binary, lower binary")


_STATE = ("ids", "of", "size", "x", "codes", "upper", "lower")


def _opened(batch: pa.RecordBatch, i: int, dim: int, parts: int):
    get = lambda c: common.column(batch, c)[i].as_py()
    x = common.unpacked(get("x"), get("size")).astype(np.int64).reshape(-1, dim)
    return x, *(np.frombuffer(get(c), kind).reshape(-1, parts).copy() for c, kind in (("codes", "<i4"), ("upper", "<f4"), ("lower", "<f4")))


def _assigned(state: DataFrame, step: Round, dim: int, parts: int) -> DataFrame:
    """The next state (kind "state") and, from each task, sums and counts of every entry's parts (kind "sum"; entry -1 counts the
    parts that were scanned in full)."""
    sub = dim // parts

    def run(batches):
        common.lean()
        entries = step.books.shape[1]
        fresh = lambda: (np.zeros((parts, entries), np.int64), np.zeros((parts, entries, sub), np.int64), np.zeros(parts, np.int64))
        count, sums, scanned = fresh()

        def sent():
            p, e = np.nonzero(count)
            p, e = np.concatenate([p, np.arange(parts)]), np.concatenate([e, np.full(parts, -1)])
            n = np.where(e >= 0, count[p, e], scanned[p])
            s = np.where((e >= 0)[:, None], sums[p, e], 0) if sub else np.zeros((len(p), 0), np.int64)
            none = lambda t: pa.nulls(len(p), t)
            flat = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * sub, pa.array(s.ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(["sum"] * len(p)), *(none(t) for t in types), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), flat], names)

        names = ["kind", *_STATE, "part", "entry", "n", "sums"]
        types = None
        for batch in batches:
            types = [common.column(batch, c).type for c in _STATE]
            for i in range(batch.num_rows):
                x, codes, upper, lower = _opened(batch, i, dim, parts)
                for p in range(parts):
                    mine, code, up, low = x[:, p * sub : (p + 1) * sub], codes[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    scanned[p] += step.assign(mine, p, code, up, low)
                    codes[:, p], upper[:, p], lower[:, p] = code, up, low
                    count[p] += np.bincount(code, minlength=entries)
                    order = np.argsort(code, kind="stable")
                    at = np.flatnonzero(np.diff(code[order], prepend=-1))
                    if sub:
                        sums[p, code[order][at]] += np.add.reduceat(mine[order], at, axis=0)
                one = batch.slice(i, 1)
                out = [common.column(one, c) for c in _STATE[:4]] + [pa.array([v.tobytes()]) for v in (codes, upper, lower)]
                yield pa.RecordBatch.from_arrays([pa.array(["state"]), *out, *(pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names)
                if count[0].sum() >= SUMMED:
                    yield sent()
                    count, sums, scanned = fresh()
        if types and count.any():
            yield sent()

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in _STATE)
    return state.select(*_STATE).mapInArrow(run, f"kind string, {kinds}, part int, entry int, n long, sums array<long>")


def _moved(sums: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """The codebooks after a round, and how many parts were scanned in full. Partial sums of all tasks are added by Spark; a row
    for each entry comes back."""
    sub = books.shape[2]
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = sums.groupBy("part", "entry").agg(total(F.col("n")).alias("n"), F.array(*[total(F.col("sums")[i]) for i in range(sub)]).alias("sums")).collect()
    out, scanned = books.copy(), 0
    for r in rows:
        if r["entry"] < 0:
            scanned += int(r["n"])
        else:
            out[r["part"], r["entry"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return out, scanned


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", scans: list[int] | None = None) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every vector without null or non-finite components.

    Components become floor(scale * x) and vectors are cut to equal parts. A part position's codebook begins as that part
    of the vectors of smallest ids; each round assigns every part to its nearest entry (squared Euclidean distance, ties to the
    lower index) and replaces entries by their parts' floored means, unused ones stay; then parts are assigned once more. code: two
    hexadecimal digits for each part. error: the final squared distances, added up over the parts. label_error: error added
    up over equal values of group_col, nulls together. codebooks_sha256: of all final entries, in decimals.

    The state of a round (whole numbers, codes, and for each part an upper bound of the distance from its entry and a lower one of that
    from all others) is written in the shared folder, and goes when the next one is written. A part is scanned in full only where
    the bounds don't fail to meet strictly, so results are those of full scans; scans, if given, gets the number of
    parts scanned in each round, the last assignment included. What comes to the driver is a row for each entry of each round;
    what goes to the tasks are the codebooks (parts * entries * their length).

    Null and non-finite vectors have no row. Null ids come last in the order of ids; of equal ids, the smaller vector is
    first; repeated rows are returned each. Fewer vectors than entries make shorter codebooks. An empty table gives an empty
    one. Vectors of different lengths, a length that parts does not divide, and components whose scaled size is 2**42 or more raise
    an error. Other columns are not read, whatever their names."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two hexadecimal digits tells 1 to 256 entries apart")
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "codes")
    rows = vectors.select(F.col(id_col).alias("k"), F.col(group_col).alias("of"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")))
    first = rows.select("k", "v").orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()
    id_kind, of_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, group_col))
    dim = len(first[0]["v"]) if first else parts
    if dim % parts or any(len(r["v"]) != dim for r in first):
        raise ValueError(f"{dim} components can't be cut to {parts} equal parts")
    sub = dim // parts
    books = whole(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim), scale).reshape(len(first), parts, sub).transpose(1, 0, 2).copy()
    if not first:
        none = rows.select(F.col("k").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.limit(0).withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    path = scratch.path(_blocks(rows, dim, parts, scale, f"{id_kind}|{of_kind}"))
    state, before = spark.read.parquet(path), None
    for _ in range(rounds):
        told, written = scratch.parted(_assigned(state, Round(books, before), dim, parts), "kind")
        scratch.drop(path)
        path, state = written, told.where("kind = 'state'")
        before, (books, scanned) = books, _moved(told.where("kind = 'sum'"), books)
        if scans is not None:
            scans.append(scanned)
    step = Round(books, before)

    def run(batches):
        common.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                x, codes, upper, lower = _opened(batch, i, dim, parts)
                error, scanned = np.zeros(len(x), object), 0
                for p in range(parts):
                    mine, code, up, low = x[:, p * sub : (p + 1) * sub], codes[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    scanned += step.assign(mine, p, code, up, low)
                    codes[:, p] = code
                    error += [int(d) for d in _paired(mine, step.books[p][code])]
                one = batch.slice(i, 1)
                text = codes.astype(np.uint8).tobytes().hex()
                n = np.zeros(len(x), np.int64)
                n[:1] = scanned
                yield pa.RecordBatch.from_arrays([common.column(one, "ids").flatten(), common.column(one, "of").flatten(), pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)]), pa.array(error.tolist(), pa.int64()), pa.array(n)], ["k", "of", "code", "error", "scanned"])

    coded = scratch.put(state.select(*_STATE).mapInArrow(run, f"k {id_kind}, of {of_kind}, code string, error long, scanned long"))
    scratch.drop(path)
    facts = coded.agg(F.count(F.lit(1)).alias("n"), F.sum("scanned").alias("scanned")).first()
    if scans is not None:
        scans.append(facts["scanned"])
    sums = scratch.put(coded.groupBy(F.col("of").alias("group")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    out = common.joined_by_weight(coded, sums, lambda a, b: a["of"].eqNullSafe(b["group"]), "rows", facts["n"])
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select(F.col("k").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds as one table expression after another; sums are of whole numbers, exact as doubles."""
    out = ["""WITH v AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, rn, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x AS c FROM p WHERE rn <= 256)"""]  # fmt: skip
    for r in range(5):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p.part, m % 256 AS entry, m // 256 AS d, x FROM (SELECT vec_id, p.part, any_value(x) AS x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + entry) AS m
  FROM p JOIN c{r} ON p.part = c{r}.part GROUP BY vec_id, p.part) AS p)""")
        if r < 4:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.part, c{r}.entry, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT part, entry, list(f ORDER BY pos) AS c FROM (
  SELECT part, entry, pos, floor(sum(val) / count(*)) AS f FROM (SELECT part, entry, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY part, entry, pos) GROUP BY part, entry) m ON c{r}.part = m.part AND c{r}.entry = m.entry)""")
    out.append("""s AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4),
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)""")
    return ",\n".join(out) + "\nSELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN v ON f.vec_id = v.vec_id, s"


ORACLE_SQL = _oracle()
