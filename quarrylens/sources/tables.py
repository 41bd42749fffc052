"""Tables to profile: CSV, Parquet, and any DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ValidationError, check_labels
from ..functions import columns as C
from ..functions import ranks

# Texts that a CSV reader takes as missing.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMATS = {".csv": "csv", ".parquet": "parquet"}


@dataclass
class Loaded:
    frame: DataFrame
    name: str
    source: str
    format: str
    rows: int
    columns: int
    bytes: int | None


def format_of(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValidationError(f"Can't tell the format of {path!r}: use .csv or .parquet.")
    return FORMATS[suffix]


def name_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem.strip() or "dataset"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Texts first; a column becomes whole numbers, numbers or booleans if all its values read as such. Dates stay texts.

    One aggregation decides all columns. Whole numbers stay whole when values are missing."""
    try:
        raw = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
        names = list(raw.columns)
    except Exception as e:  # noqa: BLE001
        raise ValidationError(f"The CSV file can't be read: {str(e).splitlines()[0]}") from e
    if not names:
        raise ValidationError("The CSV file is empty.")
    texts = raw.select([F.when(~C.name(n).isin(*NA_TEXTS), C.name(n)).alias(n) for n in names])
    tests = []
    for i, n in enumerate(names):
        c = C.name(n)
        tests += [F.count(c).alias(f"n{i}"), F.count_if(C.stripped(c).rlike(r"^[+-]?[0-9]{1,18}$")).alias(f"i{i}"), F.count(C.parsed_number(c)).alias(f"d{i}"), F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    try:
        seen = texts.agg(*tests).first()
    except Exception as e:  # noqa: BLE001
        raise ValidationError(f"The CSV file is malformed: {str(e).splitlines()[0]}") from e
    out = []
    for i, n in enumerate(names):
        c, k = C.name(n), seen[f"n{i}"]
        kind = "bigint" if k and seen[f"i{i}"] == k else "double" if k and seen[f"d{i}"] == k else "boolean" if k and seen[f"b{i}"] == k else None
        out.append((C.stripped(c).cast(kind) if kind else c).alias(n))
    return texts.select(out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        raise ValidationError(f"The Parquet file can't be read: {str(e).splitlines()[0]}") from e


def load(spark: SparkSession, path: str, name: str | None = None) -> Loaded:
    """Reads a table and looks that it has rows. bytes is Spark's estimate of the scan."""
    kind = format_of(path)
    df = (read_csv if kind == "csv" else read_parquet)(spark, path)
    if not df.columns:
        raise ValidationError("The table has no columns.")
    check_labels(df.columns)
    rows = df.count()
    if not rows:
        raise ValidationError("The table has no rows.")
    return Loaded(df, name or name_of(path), path, kind, rows, len(df.columns), scan_bytes(df))


def scan_bytes(df: DataFrame) -> int | None:
    """What the sources are estimated to hold, not the memory that a copy would take; None where Spark can't tell."""
    return ranks.source_bytes(df)


def _scanned(df: DataFrame) -> bool:
    """Whether rows come straight from files, at most chosen and computed on."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def with_order(df: DataFrame, name: str = "__order") -> DataFrame:
    """Adds the source's row order, the same however files are split, filtered or read again: file and row of Parquet; of other
    files (CSV) file, start of the block, and place among the rows of its task, which reads a block from its start to its end. Frames that
    aren't read straight from files get Spark's own order."""
    if not _scanned(df):
        return df.withColumn(name, F.monotonically_increasing_id())
    try:
        return df.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:  # only Parquet has row_index
        return df.withColumn(name, F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")))


def fingerprint(df: DataFrame, name: str) -> str:
    """12 hexadecimal digits of name, columns, rows and content, the same for any order of rows."""
    h = F.xxhash64(*[C.name(c) for c in df.columns])
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"))
    text = F.concat_ws("|", F.lit(name), F.lit(",".join(df.columns)), "n", "x", "s")
    return facts.select(F.substring(F.sha2(text, 256), 1, 12)).first()[0]


def sample_table(spark: SparkSession, rows: int = 80) -> DataFrame:
    """A small made-up table to try things on."""
    i = F.col("id")
    late = i % 5 == 0
    return spark.range(rows).select(
        F.concat(F.lit("A"), F.lpad(i.cast("string"), 4, "0")).alias("account_id"), (21 + i * 7 % 45).alias("age"), F.when(i % 9 != 4, 900.0 + i * 37 % 2500).alias("income"),
        F.element_at(F.array(F.lit("web"), F.lit("branch"), F.lit("partner")), (i % 3 + 1).cast("int")).alias("channel"), F.when(i % 2 == 0, "north").otherwise("south").alias("region"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")), "yyyy-MM-dd").alias("opened_on"), F.when(late | (i % 7 == 3), 1).otherwise(0).alias("defaulted"), F.when(i < rows * 7 // 10, "train").otherwise("test").alias("split"),
    )
