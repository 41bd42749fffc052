"""Semantic types: what a column holds, told from its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranks

# Texts that read as booleans, and the rates from which texts count as numbers or dates.
BOOLEAN_TEXTS = ("true", "false", "t", "f", "yes", "no", "y", "n", "0", "1")
NUMBER_RATE, DATE_RATE = 0.95, 0.85
DATE_SAMPLE, TEXT_SAMPLE = 200, 500
MIN_TEXT_LENGTH, MIN_TEXT_WORDS = 40, 6


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Distinct values, their share of the values that are there, and the most frequent one's share; of a value table, if given.

    One unpivoted count for all columns: counting distinct values side by side would multiply the rows by the columns."""
    columns = columns or df.columns
    counts = ranks.value_table(df, columns) if counts is None else counts.where(F.col("column").isin(*columns))
    counts = counts.where(F.col("value").isNotNull())
    small = F.lower(C.stripped(F.col("value"))).isin(*BOOLEAN_TEXTS)
    number = F.col("value").try_cast("double")
    whole = F.abs(number - F.round(number)) <= 1e-8
    out = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null_count"), F.max("n").alias("top"), F.bool_and(small).alias("reads_boolean"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole"))
    all_ = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = all_.join(out, "column", "left")
    zero = F.lit(0).cast("long")
    return out.select("column", F.coalesce("unique_count", zero).alias("unique_count"), F.coalesce("non_null_count", zero).alias("non_null_count"), C.share(F.col("unique_count"), F.col("non_null_count")).alias("unique_ratio"), C.share(F.col("top"), F.col("non_null_count")).alias("top_frequency_ratio"), F.coalesce("reads_boolean", F.lit(False)).alias("reads_boolean"), F.coalesce("whole", F.lit(False)).alias("whole"))


def parse_rates(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Shares of the texts that aren't blank which read as numbers, as booleans, and as dates (of one format: the best one; 0 if
    fewer than 85 % have digits or fewer than half a sign that dates have). Of a value table, if given, each different text is
    read once."""
    filled = F.when(C.stripped(F.col("v")) != "", C.stripped(F.col("v")))
    if counts is None:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.name(c).alias("v")) for c in columns])
        rows = df.select(F.explode(pairs).alias("p")).select("p.*").withColumn("n", F.lit(1))
    else:
        rows = counts.where(F.col("column").isin(*columns)).select("column", F.col("value").alias("v"), "n")
    rows = rows.select("column", filled.alias("v"), "n").withColumn("format", C.date_format(F.col("v")))
    rate = lambda ok: C.share(F.sum(F.when(F.col("v").isNotNull(), F.when(ok, F.col("n")).otherwise(0))), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))))
    date = F.greatest(*[rate(F.col("format") == i) for i in range(len(C.DATE_FORMATS))])
    date = F.when((rate(F.col("v").rlike(r"\d")) < DATE_RATE) | (rate(F.col("v").rlike("[-/:T ]")) < 0.5), 0.0).otherwise(date)
    found = rows.groupBy("column").agg(rate(C.parsed_number(F.col("v")).isNotNull()).alias("numeric_parse_rate"), date.alias("datetime_parse_rate"), rate(F.lower("v").isin(*BOOLEAN_TEXTS)).alias("boolean_parse_rate"))
    return _all_of(df, columns, found)


def value_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind, n): how many values of each raw text column read as whole, number, boolean, date, blank or other text, in this
    order. Counts of parts of a table add up. One scan."""
    v = F.col("v")
    kind = (
        F.when(v == "", "blank").when(v.rlike(r"^[+-]?[0-9]{1,18}$"), "whole").when(C.parsed_number(v).isNotNull(), "number")
        .when(F.lower(v).isin("true", "false"), "boolean").when(C.date_format(v).isNotNull(), "date").otherwise("text")
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.stripped(C.name(c)).alias("v")) for c in columns])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where(v.isNotNull())
    return rows.groupBy("column", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def mixed_values(kinds: DataFrame) -> DataFrame:
    """Of value_kinds(): how many kinds each column has (blanks aside, whole numbers being numbers), the most frequent one, and
    the values of all others."""
    one = kinds.where("kind <> 'blank'").withColumn("kind", F.when(F.col("kind") == "whole", "number").otherwise(F.col("kind"))).groupBy("column", "kind").agg(F.sum("n").alias("n"))
    out = one.groupBy("column").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("kind", F.struct("n", "kind")).alias("main_kind"), (F.sum("n") - F.max("n")).alias("other_values"))
    return out.withColumn("mixed", F.col("kinds") > 1)


def _firsts(df: DataFrame, columns: Sequence[str], order: Column, n: int | None) -> DataFrame:
    """(column, v, nth) of each column's first n texts in an order, or of all: one scan for all columns, or one of each where these
    read no more. A task sends n of each on at most."""
    if n is not None and ranks.by_passes(df, columns):
        parts = [df.select(order.alias("o"), C.name(c).cast("string").alias("v")).where(F.col("v").isNotNull()).orderBy("o").limit(n).select(F.lit(c).alias("column"), "v", "o") for c in columns]
        nth = F.row_number().over(Window.partitionBy("column").orderBy("o"))  # n rows of each
        return ranks.united(parts).withColumn("nth", nth).drop("o")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.name(c).cast("string").alias("v")) for c in columns])
    rows = df.select(order.alias("o"), F.explode(pairs).alias("p")).select("o", "p.*").where(F.col("v").isNotNull())
    if n is None:
        return rows.drop("o")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy("o"))).where(F.col("nth") <= n).drop("o")


def _prose() -> list[Column]:
    length, words = F.avg(F.length("v")), F.avg(C.words(F.col("v")))
    return [length.alias("mean_length"), words.alias("mean_words"), F.coalesce((length >= MIN_TEXT_LENGTH) | (words >= MIN_TEXT_WORDS), F.lit(False)).alias("text_like")]


def _dates(among: Column) -> Column:
    v, format_ = F.when(among, F.col("v")), C.date_format(C.stripped(F.col("v")))
    rate = lambda ok: F.avg(F.when(among, ok.cast("double")))
    parsed = F.greatest(*[rate(F.coalesce(format_ == i, F.lit(False))) for i in range(len(C.DATE_FORMATS))])
    return F.coalesce((rate(v.rlike(r"\d")) >= DATE_RATE) & (rate(v.rlike("[-/:T ]")) >= 0.5) & (parsed >= DATE_RATE) & (F.count_distinct(v) > 2), F.lit(False)).alias("date_like")


def _all_of(df: DataFrame, columns: Sequence[str], found: DataFrame) -> DataFrame:
    """A row for each column, those without any text too."""
    out = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(F.broadcast(found), "column", "left")
    return out.select("column", *[F.coalesce(c, F.lit(False)).alias(c) if c.endswith("_like") else c for c in found.columns if c != "column"])


def text_like(df: DataFrame, columns: Sequence[str], order: Column, first: int | None = TEXT_SAMPLE) -> DataFrame:
    """Mean length and words of each column's first texts in an order, or of all, and whether they read as prose."""
    return _all_of(df, columns, _firsts(df, columns, order, first).groupBy("column").agg(*_prose()))


def date_like(df: DataFrame, columns: Sequence[str], order: Column) -> DataFrame:
    """Whether each column's first texts have digits (85 %), signs of a date (half of them) and parse (85 %), three values or more."""
    return _all_of(df, columns, _firsts(df, columns, order, DATE_SAMPLE).groupBy("column").agg(_dates(F.lit(True))))


def id_hint(column: str) -> bool:
    low = column.strip().lower()
    return low.endswith("_id") or low in ("id", "uuid", "guid", "key") or "identifier" in low


def id_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By name, or nearly unique in 20 rows and more."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    hinted = F.col("column").isin(*[c for c in columns if id_hint(c)] or [""])
    unique = (F.col("unique_ratio") >= 0.95) & (total >= 20) & (F.col("unique_count") >= F.greatest(F.lit(20.0), 0.8 * total))
    return cardinality(df, columns).select("column", (hinted | F.coalesce(unique, F.lit(False))).alias("id_like"))


def semantic_types(df: DataFrame, near_constant: float = 0.98, high_cardinality: int = 50, dates: Sequence[str] = (), order: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row per column: its cardinality and its semantic type, by the first rule that holds.

    all_missing, constant, near_constant, datetime (configured or by type), boolean, binary, numeric_discrete,
    numeric_continuous, datetime (text that parses), text, categorical_high_cardinality, categorical_low_cardinality.
    Whole numbers 0 and 1 are boolean whether or not values are missing. order is the order of the first values
    that texts are judged by; without it Spark's own order."""
    order = F.monotonically_increasing_id() if order is None else order
    texts = C.text_columns(df)
    facts = cardinality(df, counts=counts)
    is_in = lambda names: F.col("column").isin(*names) if names else F.lit(False)
    number, text, stamp = is_in(C.numeric_columns(df)), is_in(texts), is_in([*C.time_columns(df), *dates])
    if texts:
        read = _firsts(df, texts, order, max(TEXT_SAMPLE, DATE_SAMPLE)).groupBy("column")
        some = F.col("nth") <= TEXT_SAMPLE
        length, words = F.avg(F.when(some, F.length("v"))), F.avg(F.when(some, C.words(F.col("v"))))
        read = read.agg(_dates(F.col("nth") <= DATE_SAMPLE), ((length >= MIN_TEXT_LENGTH) | (words >= MIN_TEXT_WORDS)).alias("text_like"))
        facts = facts.join(F.broadcast(read), "column", "left")  # a row for each column
    else:
        facts = facts.withColumn("date_like", F.lit(False)).withColumn("text_like", F.lit(False))
    u = F.col("unique_count")
    kind = (
        F.when(u == 0, "all_missing").when(u == 1, "constant").when(F.col("top_frequency_ratio") >= near_constant, "near_constant").when(stamp, "datetime")
        .when((u <= 2) & F.col("reads_boolean"), "boolean").when(u == 2, "binary").when(number & (u <= 20) & F.col("whole"), "numeric_discrete").when(number, "numeric_continuous")
        .when(text & F.coalesce("date_like", F.lit(False)), "datetime").when(text & F.coalesce("text_like", F.lit(False)), "text")
        .when(u > high_cardinality, "categorical_high_cardinality").otherwise("categorical_low_cardinality")
    )
    return facts.select("column", "non_null_count", "unique_count", "unique_ratio", "top_frequency_ratio", kind.alias("semantic_type"))
