"""Exact Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: A band's largest size is this many times its smallest.
BAND = 1.5
#: A shingle that so many texts of one block hold is common; of the common ones, so many are known to all (a bounded table).
COMMON_IN_BLOCK, COMMON, BLOCK_SHINGLES = 2, 500_000, 2_000_000
#: Keys are sent on in blocks of about so many.
BLOCK_KEYS, SHARD_BYTES = 500_000, 8 << 20
#: A tile that more texts of a block are in goes by rows, which no task has to gather.
HOT_IN_BLOCK = 64
#: Rounds in which the components of a tile are tried against its largest before all pairs between them are.
ROUNDS = 2
#: Members of a tile that are compared at once; larger tiles are cut, and every two cuts meet. Tiles, rows and bytes of bitmaps of a
#: bucket, and bitmap words that are compared at once.
CHUNK, BUCKET_TILES, BUCKET_ROWS, BUCKET_BYTES, AT_ONCE = 1024, 2000, 50_000, 32 << 20, 1 << 21
#: So many nodes whose sets are wanted are told to every task (16 bytes each); of more, the texts are shuffled.
TOLD_NODES = 500_000
#: A sketch as four longs.
SKETCH = ("s0", "s1", "s2", "s3")


@lru_cache(maxsize=8)
def bands(limit: int = 1 << 40) -> np.ndarray:
    """The smallest size of each band."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, np.int64)


def own_band(n: int) -> int:
    return int(np.searchsorted(bands(), n, "right")) - 1


def bands_of(n: int, percent: int) -> range:
    """A set's band, and those above that hold sets which it may be similar to."""
    return range(own_band(n), own_band(max(n, n * 100 // percent)) + 1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; fewer words make one shingle, no words none."""
    words, offsets, _, _ = common.word_hashes([t.translate(common.LOWER) for t in texts])
    all_ = common.sequence_hashes(words, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(all_[a : b - n + 1]) if b - a >= n else common.sequence_hashes(words[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(common.mix(np.array([common.mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def tile_keys(s: np.ndarray, percent: int, common_ones: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The tiles that a set is in: one for each of its bands and of its first elements.

    In one order of all elements, of two sets with a Jaccard similarity of t each has an element of the other among its
    first |s| - t|s| + 1. The order puts common elements last (common_ones: sorted hashes, then their places), so that
    a tile seldom holds sets that only share a passage. Any order would be right."""
    n = len(s)
    first = n - -(-n * percent // 100) + 1
    hashes, places = common_ones
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
        s = s[np.lexsort((s, np.where(hashes[at] == s, places[at] + 1, 0)))]
    s = s[:first]
    return np.concatenate([common.mix(s + np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)) for band in bands_of(n, percent)])


def bitmap(s: np.ndarray, percent: int) -> bytes:
    """Parity bits of the hashed elements. Two maps of one length differ in no more bits than the sets in elements."""
    largest, bits = int(bands()[own_band(len(s)) + 1]), 64
    while bits < 32 * largest * (100 - percent) // (100 + percent):  # 16 bits for each element that two similar sets can differ in
        bits *= 2
    count = np.bincount((common.mix(s + np.uint64(0x1F83D9AB)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of 256 bits whatever the set's size: it rules most pairs out before their bitmaps are looked at."""
    count = np.bincount((common.mix(s + np.uint64(0x1F83D9AB)) & np.uint64(255)).astype(np.int64), minlength=256)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def most_apart(a: int, b: int, percent: int) -> int:
    """In how many elements similar sets of these sizes can differ; below 0 if they can't be similar."""
    overlap = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * overlap if overlap <= min(a, b) else -1


def may_link(a: int, map_a: bytes, b: int, map_b: bytes, percent: int) -> bool:
    """Bounds the overlap from above by the maps' bit counts; the longer map is folded to the shorter."""
    apart = most_apart(a, b, percent)
    if apart < 0:
        return False
    x, y = np.frombuffer(map_a, np.uint8), np.frombuffer(map_b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= apart


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union, of sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def common_shingles(docs: DataFrame, n: int, scratch: common.Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles (sorted hashes) and their places, rarest first. Blocks of texts count for themselves and tell
    those that several of their texts hold. Which of all are known is told by a histogram of the counts' logarithms, so what
    comes to the driver, or to one task, is COMMON rows at most."""

    def run(batches):
        def often(sets):
            h, count = np.unique(np.concatenate(sets), return_counts=True)
            many = count >= COMMON_IN_BLOCK
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(count[many])], ["h", "n"])

        sets = []
        for piece in (p for batch in batches for p in common.pieces(batch, "t")):
            sets += shingle_sets(common.encoded(common.column(piece, "t")), n)
            if sum(map(len, sets)) >= BLOCK_SHINGLES:
                yield often(sets)
                sets = []
        if sets:
            yield often(sets)

    counts = docs.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = scratch.put(counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    least, total = 1 << 30, 0
    for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect():  # 512 levels at most
        if (total := total + r["c"]) > COMMON:
            break
        least = r["level"]
    rows = counts.where(F.col("level") >= least).select("h", "n").toArrow()
    h, count = np.array(rows["h"]).view(np.uint64), np.array(rows["n"])
    order = np.argsort(h)
    places = np.empty(len(h), np.int64)
    places[np.lexsort((h, count))] = np.arange(len(h))
    return h[order], places[order]


def _tiles(docs: DataFrame, n: int, percent: int, shards: int, sent) -> DataFrame:
    """Part "doc": id, size, node and bitmap of each text. Part "key": of each shard, the tiles of this block and their nodes.
    Part "hot": nodes of tiles that many texts of this block are in; of such a tile only one node is among the keys."""
    id_type = to_arrow_type(docs.schema["k"].dataType)
    names = ["part", "shard", "a", "b", "c", "ids", "maps"]
    types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.binary())]

    def flush(ids, sizes, nodes, maps, keys, sketches):
        rows = [("doc", -1, common.packed(np.array(sizes, "<i8")), np.array([x or 0 for x in nodes], "<i8").tobytes(), b"".join(sketches), ids, maps)]
        seen = {k: v for k, v in zip(nodes, keys, strict=True) if v is not None}
        if seen:
            node = np.sort(np.array(list(seen), np.int64))
            key = np.concatenate([seen[x] for x in node.tolist()])
            at = np.repeat(np.arange(len(node), dtype=np.uint32), [len(seen[x]) for x in node.tolist()])
            shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            order = np.lexsort((at, key & np.uint64(0xFFFFFFFF), shard))
            key, at, shard = (key & np.uint64(0xFFFFFFFF))[order], at[order], shard[order]
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(key)))
            hot = np.repeat(size > HOT_IN_BLOCK, size)
            if hot.any():
                rows.append(("hot", -1, ((shard[hot] << np.uint64(32)) | key[hot]).astype("<i8").tobytes(), node[at[hot]].astype("<i8").tobytes(), b"", [], []))
                keep = first | ~hot
                key, at, shard = key[keep], at[keep], shard[keep]
            edges = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1, append=-1)).tolist()  # of the shards that occur
            for lo, hi in zip(edges, edges[1:], strict=False):
                mine, back = np.unique(at[lo:hi], return_inverse=True)
                rows.append(("key", int(shard[lo]), common.packed(np.diff(key[lo:hi], prepend=np.uint64(0)).astype("<u4")), common.packed(back.astype("<u4")), node[mine].astype("<i8").tobytes(), [], []))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    def run(batches):
        held = ids, sizes, nodes, maps, keys, sketches = [], [], [], [], [], []
        count = 0
        for piece in (p for batch in batches for p in common.pieces(batch, "t")):
            ids += common.column(piece, "k").to_pylist()
            for s in shingle_sets(common.encoded(common.column(piece, "t")), n):
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                maps.append(bitmap(s, percent) if len(s) else b"")
                sketches.append(sketch(s))
                keys.append(tile_keys(s, percent, sent.value) if len(s) else None)
                count += len(keys[-1]) if len(s) else 0
            if count >= BLOCK_KEYS or len(ids) >= 50_000:
                yield from flush(*held)
                held = ids, sizes, nodes, maps, keys, sketches = [], [], [], [], [], []
                count = 0
        if ids:
            yield from flush(*held)

    return docs.mapInArrow(run, f"part string, shard int, a binary, b binary, c binary, ids array<{docs.schema['k'].dataType.simpleString()}>, maps array<binary>")


def _shared_tiles(table: pa.Table) -> pa.Table:
    """The tiles of a shard that several nodes are in, and these nodes."""
    common.lean()
    key, node = [], []
    for a, b, c in zip(*(table[x].to_pylist() for x in "abc"), strict=True):
        key.append(np.cumsum(common.unpacked(a, "<u4"), dtype=np.uint64).astype(np.uint32))
        node.append(np.frombuffer(c, "<i8")[common.unpacked(b, "<u4")])
    key, node = np.concatenate(key), np.concatenate(node)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[new], node[new]
    same = key[1:] == key[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return pa.table({"tile": (table["shard"][0].as_py() << 32) | key[shared].astype(np.int64), "x": node[shared]})


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Parity maps as rows of bytes, folded to a width."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _open_tiles(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of each tile's members, from different components, whose sizes and bitmaps allow a link. A bitmap is as long as its
    set's band asks for; the longer of two is folded. Many pairs are compared at once."""
    common.lean()
    col = {c: np.array(table[c]) for c in ("tile", "upper", "same", "x", "size", "root")}
    maps = table["map"].to_pylist()
    order = np.lexsort((col["x"], col["tile"]))
    col = {c: v[order] for c, v in col.items()}
    edges = np.flatnonzero(np.concatenate([[True], col["tile"][1:] != col["tile"][:-1], [True]]))
    out_x, out_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        root, size, x, upper = (col[c][lo:hi] for c in ("root", "size", "x", "upper"))
        if (root == root[0]).all():
            continue
        same = bool(col["same"][lo])
        bits = [maps[i] for i in order[lo:hi].tolist()]
        width = np.fromiter(map(len, bits), np.int64, len(bits))
        for w in np.unique(width).tolist():
            a, b = np.flatnonzero(width == w), np.flatnonzero(width >= w)
            short = np.empty((len(b), w // 8), np.uint64)
            for full in np.unique(width[b]).tolist():
                at = np.flatnonzero(width[b] == full)
                short[at] = folded(np.frombuffer(b"".join([bits[k] for k in b[at].tolist()]), np.uint8).reshape(len(at), full), w).view(np.uint64)
            mine = short[np.searchsorted(b, a)]
            step = max(1, AT_ONCE // max(1, short.size))
            for start in range(0, len(a), step):
                i, j = a[start : start + step, None], b[None, :]
                both = size[i] + size[j]
                overlap = -(-percent * both // (100 + percent))
                fit = (root[i] != root[j]) & ((width[j] > w) | (i < j)) & (overlap <= np.minimum(size[i], size[j]))
                if not same:
                    fit &= upper[i] != upper[j]
                if fit.any():
                    fit &= np.bitwise_count(mine[start : start + step, None, :] ^ short[None, :, :]).sum(2) <= both - 2 * overlap
                    p, q = np.nonzero(fit)
                    left, right = x[a[start + p]], x[b[q]]
                    out_x.append(np.maximum(left, right))
                    out_y.append(np.minimum(left, right))
    pairs = np.unique(np.stack([np.concatenate(out_x), np.concatenate(out_y)], 1), axis=0)
    return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]})


def _buckets(mixed: DataFrame) -> int:
    """How many buckets hold all tiles: each has about BUCKET_TILES tiles or cuts and BUCKET_ROWS rows of one size at most, and a
    member is a row for each cut of its tile."""
    r = mixed.agg(F.sum("chunks").alias("tiles"), F.sum(F.col("n") * F.col("chunks")).alias("rows")).first()
    return max((r["tiles"] or 0) // BUCKET_TILES, (r["rows"] or 0) // BUCKET_ROWS) + 1


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have edges (x, y). Alternating large and small
    stars; each round is written in the shared folder. The number of rounds grows with the logarithm of the size."""
    e = scratch.put(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), F.least("x", "m").alias("m"))
        e = both.join(low, both["x"] == low["u"]).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), "m")
        hops = e.join(low, e["x"] == low["u"])
        e = scratch.put(hops.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        mark = now


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bit counts allow a link: first by the sketches, in the JVM, then by the bitmaps of those left.
    Joined alike at every size: nodes are never broadcast."""
    rough = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), *[F.col(k).alias(f"{c}{k}") for k in SKETCH]).hint("merge")
    both = F.col("sx") + F.col("sy")
    overlap = F.floor((percent * both + (99 + percent)) / (100 + percent))
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in SKETCH[1:]), F.bit_count(F.col("xs0").bitwiseXOR(F.col("ys0"))))
    pairs = pairs.join(rough("x"), "x").join(rough("y"), "y").where((overlap <= F.least("sx", "sy")) & (apart <= both - 2 * overlap)).select("x", "y")

    def bound(batches):
        for b in batches:
            keep = [may_link(*r, percent) for r in zip(*(common.column(b, c).to_pylist() for c in ("sx", "mx", "sy", "my")), strict=True)]
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("map").alias(f"m{c}"))
    return pairs.join(side("x").hint("merge"), "x").join(side("y").hint("merge"), "y").select("x", "y", "sx", "mx", "sy", "my").mapInArrow(bound, "x long, y long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by intersection of their arrays. Joined alike at every size, too."""

    def exact(batches):
        common.lean()
        for b in batches:
            keep = [links(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), percent) for p, q in zip(common.column(b, "ax").to_pylist(), common.column(b, "ay").to_pylist(), strict=True)]
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("elements").alias(f"a{c}"))
    return pairs.join(side("x").hint("merge"), "x").join(side("y").hint("merge"), "y").select("x", "y", "ax", "ay").mapInArrow(exact, "x long, y long")


def groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links, itself included) for each row.

    Two texts link if 100 * intersection >= percent * union of their sets of n-word shingles (A-Z lower-cased, words between
    ASCII white space). Null, empty and blank texts link with nothing and keep their own id. Rows with equal sets are one
    node, so copies cost nothing more; rows that share an id but not a set are told apart. A component whose ids are all null
    has a null id. An empty table gives an empty one. Other columns are not read.

    Tiles: sets of like size (a band) that share one of their rarest elements. Similar sets are sure to share a tile, and
    sets that only share a passage seldom do. A tile links each member to its smallest, first within a block and then over
    blocks, so a hot tile is one row from each block. These pairs are bounded by bit counts and then verified. In tiles whose members
    are not in one component after that, members of the others are tried against the largest, a few rounds; what still isn't one
    component is opened: all pairs of members from different components are verified. So no link between components is lost,
    and no pairs are listed within one."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = int(max(8, -(-size // SHARD_BYTES)))
    sent = spark.sparkContext.broadcast(common_shingles(rows, n, scratch))
    packed, path = scratch.parted(_tiles(rows, n, percent, shards, sent), "part")
    kind = docs.schema[id_col].dataType.simpleString()

    def doc_rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: common.column(batch, c)[i].as_py()  # noqa: E731, B023
                one = batch.slice(i, 1)
                parts = np.frombuffer(get("c"), "<i8").reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([common.column(one, "ids").flatten(), pa.array(common.unpacked(get("a"), "<i8")), pa.array(np.frombuffer(get("b"), "<i8")), common.column(one, "maps").flatten(), *(pa.array(np.ascontiguousarray(x)) for x in parts)], ["k", "size", "node", "map", *SKETCH])

    def hot_rows(batches):
        for batch in batches:
            for a, b in zip(common.column(batch, "a").to_pylist(), common.column(batch, "b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), pa.array(np.frombuffer(b, "<i8"))], ["tile", "x"])

    told = packed.where("part = 'doc'").select("a", "b", "c", "ids", "maps").mapInArrow(doc_rows, f"k {kind}, size long, node long, map binary, " + ", ".join(f"{c} long" for c in SKETCH))
    texts = scratch.put(told.select("k", "size", "node"))
    nodes = scratch.put(told.where("size > 0").groupBy("node").agg(F.min("k").alias("low"), F.first("size").alias("size"), F.first("map").alias("map"), *[F.first(c).alias(c) for c in SKETCH]))
    hot = packed.where("part = 'hot'").select("a", "b").mapInArrow(hot_rows, "tile long, x long")
    shared = packed.where("part = 'key'").select("shard", "a", "b", "c").groupBy("shard").applyInArrow(_shared_tiles, "tile long, x long")
    tiles = scratch.put(shared.unionByName(hot).distinct())
    scratch.drop(path)

    def sets_of(batches):
        names = ["node", "elements"]
        for piece in (p for batch in batches for p in common.pieces(batch, "t")):
            found = []
            for s, want in zip(shingle_sets(common.encoded(common.column(piece, "t")), n), common.column(piece, "want").to_pylist(), strict=True):
                if len(s) and node_of(s) == want:
                    found.append((want, s.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names)

    made: list[DataFrame] = []  # sets by node, so far

    def verified(pairs: DataFrame) -> DataFrame:
        """Bounds pairs, takes the sets of what is left from the texts, but for those that were taken before, and intersects."""
        left = scratch.put(_bounded(pairs, nodes, percent))
        want = left.select(F.col("x").alias("node")).unionByName(left.select(F.col("y").alias("node"))).distinct()
        for sets in made:
            want = want.join(sets.select("node"), "node", "left_anti")
        want = scratch.put(want.join(nodes.select("node", "low"), "node").select(F.col("node").alias("want"), "low"))
        few = want.count()
        if few:
            found = rows.join(F.broadcast(want) if few <= TOLD_NODES else want, rows["k"].eqNullSafe(want["low"]))
            made.append(scratch.put(found.select("t", "want").mapInArrow(sets_of, "node long, elements binary").dropDuplicates(["node"])))
        sets = None
        for x in made:
            sets = x if sets is None else sets.unionByName(x)
        return left if sets is None else scratch.put(_exact(left, sets, percent))

    both_ways = lambda e: e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    in_tiles = tiles.count()
    of_tile = lambda a, b: a["tile"] == b["of"]
    stars = scratch.put(tiles.groupBy(F.col("tile").alias("of")).agg(F.min("x").alias("y"), F.count(F.lit(1)).alias("rows")))
    tested = scratch.put(both_ways(common.joined_by_weight(tiles, stars, of_tile, "rows", in_tiles).where("x <> y")).distinct())
    linked = verified(tested)
    roots = scratch.put(components(linked, scratch))

    def rooted() -> DataFrame:
        return tiles.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))

    def joined(more: DataFrame) -> DataFrame:
        return scratch.put(components(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(more), scratch))

    for r in range(ROUNDS):  # one member of each component in a tile meets one of the tile's largest component
        luck = F.xxhash64(F.lit(r), "x")
        members = rooted().groupBy("tile", "root").agg(F.min_by("x", luck).alias("x"), F.count(F.lit(1)).alias("n"))
        centres = members.groupBy("tile").agg(F.count(F.lit(1)).alias("parts"), F.max_by("x", F.struct("n", "x")).alias("y")).where("parts > 1").select("tile", "y")
        pairs = both_ways(members.join(centres, "tile").where("x <> y")).distinct()
        pairs = scratch.put(pairs.join(tested, ["x", "y"], "left_anti"))
        more = verified(pairs)
        if more.isEmpty():
            break
        tested = tested.unionByName(pairs)
        roots = joined(more)
    # a tile of two was settled by its star; of tiles with the same members, one is opened
    now = scratch.put(rooted())
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "x")).alias(f"m{i}") for i in (1, 2)]
    mixed = now.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), *marks).where("lo <> hi and n > 2")
    mixed = scratch.put(mixed.groupBy("n", "m1", "m2").agg(F.min("tile").alias("of")).select("of", "n", F.ceil(F.col("n") / CHUNK).alias("chunks")))
    members = scratch.put(common.joined_by_weight(now, mixed, of_tile, "n", in_tiles).select("tile", "x", "root", "n", "chunks"))
    lengths = members.groupBy("x").agg(F.sum("chunks").alias("rows")).join(nodes.select(F.col("node").alias("x"), F.octet_length("map").alias("bytes")).hint("merge"), "x")
    buckets = max(_buckets(mixed), (lengths.agg(F.sum(F.col("rows") * F.col("bytes"))).first()[0] or 0) // BUCKET_BYTES + 1)
    members = members.join(nodes.select(F.col("node").alias("x"), "size", "map").hint("merge"), "x")
    own = F.pmod(F.xxhash64("x"), F.col("chunks"))
    members = members.select("tile", "x", "size", "root", "map", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    members = members.select(F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), (F.col("own") > F.col("other")).alias("upper"), (F.col("own") == F.col("other")).alias("same"), "x", "size", "root", "map")
    members = members.withColumn("bucket", F.pmod("tile", F.lit(buckets)))
    opened = members.groupBy("bucket").applyInArrow(lambda t: _open_tiles(t, percent), "x long, y long").distinct()
    more = verified(scratch.put(opened.join(tested, ["x", "y"], "left_anti")))
    if not more.isEmpty():
        roots = joined(more)
    by_node = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_node.groupBy("root").agg(F.min("low").alias("component_id"))
    named = by_node.join(least, "root").select(F.col("node").alias("of"), "component_id")
    out = texts.join(named, (texts["node"] == named["of"]) & (texts["size"] > 0), "left")
    return out.select(F.col("k").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest, with all their columns. Of rows that repeat an id, and are in the
    same place, one stays: that of the smallest text."""
    (kept,) = common.fresh(docs, "kept")
    found = groups(docs, n, percent, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(kept)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found[kept]), "left_semi")


def op4(spark, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"), n=3, percent=90)
