"""Row and column counts, duplicates and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

# Texts and numbers that often stand for a missing value.
MISSING_TEXTS = ("", "na", "n/a", "nan", "none", "null", "unknown", "unk", "missing", "not available")
MISSING_NUMBERS = (-1.0, -9.0, -99.0, 999.0, 9999.0, 99999.0)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def digest(df: DataFrame, salt: int) -> Column:
    """64 bits of a whole row; missing values count by their place."""
    return F.xxhash64(F.lit(salt), *[c for n in df.columns for c in (C.name(n), C.name(n).isNull())])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one: all but the first of each distinct row. Rows are told apart by 128 bits, so 16 bytes of a row are
    shuffled; that any two different ones of n rows are taken for one has a probability of about n**2 / 2**129."""
    groups = df.groupBy(digest(df, 1).alias("a"), digest(df, 2).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("duplicate_percentage", C.share(F.col("duplicate_rows"), F.col("rows")))


def duplicate_ids(df: DataFrame, ids: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Of each id column: rows that repeat a value; nulls equal each other. One row per column from one scan, or of a value table."""
    if counts is None:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.name(c).cast("string").alias("value")) for c in ids])
        groups = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        groups = counts.where(F.col("column").isin(*ids))
    return groups.groupBy("column").agg(F.sum(F.col("n") - 1).alias("duplicate_values"), F.count(F.lit(1)).alias("distinct_values"))


def column_missingness(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Missing, present, zero and blank counts of every column in one scan, or of a value table. zero_count is null for columns
    without numbers."""
    if counts is not None:
        return _missingness_of(df, list(columns or df.columns), counts)
    out = []
    for c in columns or df.columns:
        kind, x = df.schema[c].dataType, C.name(c)
        zero = F.count_if(x.cast("double") == 0) if isinstance(kind, T.NumericType) else F.count_if(~x) if isinstance(kind, T.BooleanType) else F.lit(None).cast("long")
        blank = F.count_if(C.stripped(x) == "") if isinstance(kind, T.StringType) else F.lit(0).cast("long")
        n, total = F.count(x), F.count(F.lit(1))
        out.append(F.struct(F.lit(c).alias("column"), (total - n).alias("missing_count"), n.alias("non_null_count"), C.share(total - n, total).alias("missing_percentage"), zero.alias("zero_count"), blank.alias("blank_string_count")))
    return C.rows_of(df, out)


def _missingness_of(df: DataFrame, columns: list[str], counts: DataFrame) -> DataFrame:
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0).cast("long"))
    text, value = F.col("column").isin(*C.text_columns(df), ""), F.col("value")
    seen = counts.groupBy("column").agg(total(value.isNull()).alias("gone"), total(value.isNotNull()).alias("there"), total(F.col("number") == 0).alias("zeros"), total(text & (C.stripped(value) == "")).alias("blanks"))
    out = df.sparkSession.createDataFrame([(c, c in numbers) for c in columns], "column string, counted boolean").join(F.broadcast(seen), "column", "left")  # a row for each column
    gone, there = (F.coalesce(c, F.lit(0).cast("long")) for c in ("gone", "there"))
    zero, blank = (F.coalesce(c, F.lit(0).cast("long")) for c in ("zeros", "blanks"))
    return out.select("column", gone.alias("missing_count"), there.alias("non_null_count"), C.share(gone, gone + there).alias("missing_percentage"), F.when(F.col("counted"), zero).alias("zero_count"), blank.alias("blank_string_count"))


def row_missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and most missing columns of a row, and rows that miss half of them or more."""
    columns = columns or df.columns
    gone = sum((C.name(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.select(gone.alias("m")).agg(F.avg("m").alias("mean_missing_columns"), F.max("m").cast("long").alias("max_missing_columns"), F.count_if(F.col("m") >= len(columns) / 2.0).alias("rows_half_missing"))


def high_missingness(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    return column_missingness(df).where(F.col("missing_percentage") >= threshold).select("column", "missing_percentage")


def missing_flag_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two columns' missing flags, in one aggregation."""
    flag = lambda c: C.name(c).isNull().cast("double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return C.rows_of(df, [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), C.correlation(flag(a), flag(b)).alias("correlation")) for a, b in pairs])


def special_missing_codes(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(column, code, n) of the codes that occur. An empty text is both blank and a code. In one scan, or of a value table."""
    if counts is not None:
        among = lambda names: F.col("column").isin(*[c for c in columns or df.columns if c in names], "")
        text, number = F.lower(C.stripped(F.col("value"))), F.col("number")
        code = F.when(among(C.text_columns(df)) & text.isin(*MISSING_TEXTS), text).when(among(C.numeric_columns(df)) & number.isin(*MISSING_NUMBERS), number.cast("long").cast("string"))
        return counts.select("column", code.alias("code"), "n").where(F.col("code").isNotNull()).groupBy("column", "code").agg(F.sum("n").alias("n"))
    pairs = []
    for c in columns or df.columns:
        kind, x = df.schema[c].dataType, C.name(c)
        if isinstance(kind, T.StringType):
            code = F.lower(C.stripped(x))
            pairs.append(F.struct(F.lit(c).alias("column"), F.when(code.isin(*MISSING_TEXTS), code).alias("code")))
        elif isinstance(kind, T.NumericType):
            v = x.cast("double")
            pairs.append(F.struct(F.lit(c).alias("column"), F.when(v.isin(*MISSING_NUMBERS), v.cast("long").cast("string")).alias("code")))
    rows = df.select(F.explode(F.filter(F.array(*pairs), lambda p: p["code"].isNotNull())).alias("p")).select("p.*")
    return rows.groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"))


def missing_by_response(df: DataFrame, response: Column, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """The 0/1 response's rate where a column is missing and where it is present, and the gap; of a value table with this response's
    classes, if given."""
    if counts is not None:
        total = lambda c, on: F.sum(F.when(on, F.col(c)))
        rate = lambda on: C.share(total("n1", on), total("n1", on) + total("n0", on))
        gone, there = F.col("value").isNull(), F.col("value").isNotNull()
        seen = counts.groupBy("column").agg(F.coalesce(total("n", gone), F.lit(0).cast("long")).alias("missing_count"), rate(gone).alias("response_rate_missing"), rate(there).alias("response_rate_present"))
        all_ = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(F.broadcast(seen), "column", "left")  # a row for each column
        return all_.select("column", F.coalesce("missing_count", F.lit(0).cast("long")).alias("missing_count"), "response_rate_missing", "response_rate_present", (F.col("response_rate_missing") - F.col("response_rate_present")).alias("response_rate_gap"))
    out = []
    for c in columns:
        x = C.name(c)
        gone, there = F.avg(F.when(x.isNull(), response)), F.avg(F.when(x.isNotNull(), response))
        out.append(F.struct(F.lit(c).alias("column"), F.count_if(x.isNull()).alias("missing_count"), gone.alias("response_rate_missing"), there.alias("response_rate_present"), (gone - there).alias("response_rate_gap")))
    return C.rows_of(df, out)


def missing_by_segment(df: DataFrame, segment: str, columns: Sequence[str], top: int = 20) -> DataFrame:
    """Missing share of every column in each of the largest segments; ties of size by name."""
    s = C.label(C.name(segment)).alias("segment_value")
    rates = df.groupBy(s).agg(F.count(F.lit(1)).alias("n"), *[F.avg(C.name(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
    rates = rates.orderBy(F.desc("n"), "segment_value").limit(top)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_percentage")) for i, c in enumerate(columns)])
    return rates.select("segment_value", F.explode(pairs).alias("p")).select("segment_value", "p.*")
