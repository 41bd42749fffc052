"""Column expressions that the operators are built from. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "<MISSING>"
#: Numbers as text parsers read them; Java's suffixes (1d, 1f) and hexadecimals are not among them.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy")


def name(column: str) -> Column:
    """A column by its literal name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def normalised(df: DataFrame) -> DataFrame:
    """NaN becomes null and decimals become doubles: after that there is one kind of missing value."""
    out = []
    for f in df.schema.fields:
        c = name(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(out)


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) or (booleans and isinstance(f.dataType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def as_number(df: DataFrame, column: str) -> Column:
    c = name(column)
    return c.cast("int").cast("double") if isinstance(df.schema[column].dataType, T.BooleanType) else c.cast("double")


def label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parsed_number(c: Column) -> Column:
    """The number that a text reads as, else null."""
    s = stripped(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parsed_time(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(stripped(c.cast("string")), F.lit(fmt))


def date_format(c: Column) -> Column:
    """Which of DATE_FORMATS a text reads by, as a number; else null. A text's digits and signs fit one format alone, so it is
    parsed by that one; only years with a sign are tried by every format."""
    shape = F.translate(c, "012345678", "999999999")
    fits = [F.when((shape == re.sub("[A-Za-z]", "9", f.replace("'T'", "\0")).replace("\0", "T")) & parsed_time(c, f).isNotNull(), F.lit(i)) for i, f in enumerate(DATE_FORMATS)]
    signed = [F.when(shape.rlike("^[+-]9") & parsed_time(c, f).isNotNull(), F.lit(i)) for i, f in enumerate(DATE_FORMATS)]
    return F.coalesce(*fits, *signed)


def words(c: Column) -> Column:
    """Number of words between white space; 0 for blank text."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def share(part: Column, whole: Column) -> Column:
    """A rate in doubles; null over nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; null where a side is constant (corr itself would raise)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # the variance of a constant can come out as a rounding error of its square
    spread = lambda v: F.when(F.min(v) < F.max(v), F.stddev_pop(v))
    return F.try_divide(F.covar_pop(x, y), spread(x) * spread(y))


def skewness(x: Column) -> Column:
    """Adjusted for bias; 0 for a constant, null for fewer than 3 values."""
    n = F.count(x).cast("double")
    g = F.when(F.min(x) < F.max(x), F.skewness(x))
    return F.when(n > 2, F.coalesce(F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g, F.lit(0.0)))


def kurtosis(x: Column) -> Column:
    """Excess, adjusted for bias; 0 for a constant, null for fewer than 4 values."""
    n = F.count(x).cast("double")
    g = F.when(F.min(x) < F.max(x), F.kurtosis(x))
    return F.when(n > 3, F.coalesce(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6), F.lit(0.0)))


def rows_of(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One aggregation over df, its structs as rows: all columns are profiled in one scan."""
    return df.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for results that are compared."""
    return df.select([F.round(name(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else name(f.name) for f in df.schema.fields])
