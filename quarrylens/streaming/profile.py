"""Profiles of a stream: counts by column that grow with every micro-batch, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import missingness


def profiled(stream: DataFrame, sink: Callable[[DataFrame, int], None], columns: Sequence[str] | None = None):
    """A writer that gives the sink each micro-batch's missing and blank counts by column, with the batch's number.

    Counts of batches add up, so a sink that keeps (batch, column) once has the stream's totals whatever is replayed."""

    def batch(df: DataFrame, n: int) -> None:
        sink(missingness.column_missingness(C.normalised(df), columns).drop("missing_percentage").withColumn("batch", F.lit(n)), n)

    return stream.writeStream.foreachBatch(batch)


def windowed(stream: DataFrame, time: str, value: str, size: str = "1 hour", late: str = "2 hours", by: Sequence[str] = ()) -> DataFrame:
    """Rows, missing values, mean and extremes of a column in windows of event time; rows later than late are left out."""
    x = C.name(value)
    out = stream.withWatermark(time, late).groupBy(F.window(C.name(time), size), *by)
    return out.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
