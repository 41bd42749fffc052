"""What the text operators share: reading, scratch tables, Arrow batches, vectorised words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps the ASCII capitals to small letters and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The bytes that bytes.split() and bytes.strip() take as white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Texts are worked on in pieces of about so many bytes, to bound a worker's memory; a text is never cut.
PIECE_BYTES = 2 << 20
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local one on a local master, as in
    tests; on any other an error, as no host would see another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quarrylens.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.quarrylens.scratch", found)
    return found.rstrip("/")


#: Scratch folders begun within the scopes that are open, innermost last.
_SCOPES: list[list[Scratch]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Frees, at its end, all scratch tables begun in it. What was made of them has to be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.drop(scratch.root)


class Scratch:
    """Tables written in the shared folder: they cut the lineage and outlive lost executors. They go at the end of the scope
    they were begun in, else when the driver ends, as results may be read until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _SCOPES:
            _SCOPES[-1].append(self)

    def put(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path(df))

    def path(self, df: DataFrame) -> str:
        return self._write(df.write)

    def parted(self, df: DataFrame, by: str) -> tuple[DataFrame, str]:
        """Written in a folder for each value of a column, so that each can be dropped."""
        path = self._write(df.write.partitionBy(by))
        return self.spark.read.schema(df.schema).parquet(path), path

    def _write(self, writer) -> str:
        self.n += 1
        writer.parquet(path := f"{self.root}/{self.n}")
        if self.n == 1:
            self._files(self.root).deleteOnExit(self._place(self.root))
        return path

    def drop(self, path: str) -> None:
        """Frees a table that nothing reads any more."""
        self._files(path).delete(self._place(path), True)

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._place(path).getFileSystem(self.spark._jsc.hadoopConfiguration())


#: A key of fewer rows is not hot in any table.
LEAST_HOT = 1000


def joined_by_weight(left: DataFrame, right: DataFrame, on, weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and tells how many rows are of it.

    A key of a thousandth of all rows or more would meet in one task; there are a thousand of such at most, so they are
    broadcast. All others are shuffled. on(left, right) is the condition."""
    limit = max(LEAST_HOT, total // 1000)
    hot = F.broadcast(right.where(F.col(weight) >= limit))
    cold = right.where(F.col(weight) < limit)
    rest = left.join(hot, on(left, hot), "left_anti")
    return left.join(hot, on(left, hot)).unionByName(rest.join(cold, on(rest, cold)))


def lean() -> None:
    """Makes a worker give memory back as soon as a large array is freed, as many workers share an executor's bound: blocks of
    4 MB and more are mapped, and Arrow allocates like everything else. Smaller blocks are kept, as mapping an array of some
    hundred KB costs more than filling it. Has no effect where the C library can't be told."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 24)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass
    pa.set_memory_pool(pa.system_memory_pool())


#: The large model that a worker process holds from task to task, by its name: one at most.
_MODEL: dict[tuple, object] = {}


def model(name: tuple, make: Callable):
    """The worker's model of that name; it takes the place of any other, with all that the other remembered."""
    if name not in _MODEL:
        drop_model()
        _MODEL[name] = make()
    return _MODEL[name]


def drop_model(but: tuple | None = None) -> None:
    """Frees the worker's model unless it is of that name. Workers serve all stages of an application, and what an earlier one
    remembers would stand beside a later one's tables."""
    if not _MODEL or but in _MODEL:
        return
    _MODEL.clear()
    trim()


def trim() -> None:
    """Gives freed memory back. At a task's end, as workers wait beside those of later stages."""
    with contextlib.suppress(OSError, AttributeError):  # as in lean()
        ctypes.CDLL(None).malloc_trim(0)


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: first all lowest bytes, then the next, and so on, so that small numbers cost little."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"", 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have (Spark takes no notice of case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        found = f"__{name}"
        while found.lower() in taken:
            found += "_"
        taken.add(found.lower())
        out.append(found)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encoded(array: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def decoded(array: pa.Array) -> list[str]:
    """The texts, null as empty. Bytes that are not UTF-8 are read as U+FFFD."""
    return [x.decode(errors="replace") for x in encoded(array)]


def small_batches(spark: SparkSession) -> None:
    """Workers get batches of BATCH_BYTES, not of up to 64 MB of texts, unless the session has a size of its own. All of a batch
    stays in memory, in Spark and in the worker, until its last piece is done."""
    if spark.conf.get(_BATCH, "64m").lower() in ("64m", "64mb", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece holds about limit bytes of text, one row at least."""
    lean()
    sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(column(batch, text)), 0)))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def over_batches(df: DataFrame, make: Callable[[], Callable], schema: str, text: str = "text", holds: tuple | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """mapInArrow over pieces of batches. make() runs once a task and gives f(piece) -> arrays in the order of the schema. A model
    that the worker holds goes, but for the one named. A piece has about piece_bytes of text. What only f holds is free at the
    task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        lean()
        drop_model(holds)
        f = make()
        for batch in batches:
            for piece in pieces(batch, text, piece_bytes):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c.cast(t.type) for c, t in zip(f(piece), out, strict=True)], schema=out)
        f = batch = piece = None
        trim()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space) of all texts, found and hashed without a loop over words.

    Each eight bytes of a word are mixed with their place, and the sum of these is mixed with the length: words of one
    length up to eight bytes never have one hash. Returns a 64-bit hash of each word, the offset of each text's first word (one
    more at the end), and each word's first byte and the byte past its last in b" ".join(texts)."""
    joined = b" ".join(texts) + b" " * 8
    flat = np.frombuffer(joined, np.uint8)
    edge = np.diff(SPACE[flat].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = ends - starts
    chunks = (sizes + 7) >> 3
    first = np.cumsum(chunks) - chunks
    place = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    at = np.repeat(starts, chunks) + 8 * place
    spare = np.maximum(0, 8 - np.repeat(ends, chunks) + at).astype(np.uint64)  # bytes past the word's end
    eight = np.ndarray((len(flat) - 7,), "<u8", buffer=joined, strides=(1,))
    salts = mix(np.arange(1, int(chunks.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = mix((eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * spare))) ^ salts[place])
    hashes = mix(np.add.reduceat(mixed, first) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if len(first) else np.zeros(0, np.uint64)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return hashes, np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64), starts, ends


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbouring words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + count] + np.uint64(i + 1))
    return h
