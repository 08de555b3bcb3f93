"""Mergeable statistics of series: by page, by chunk, by series.

A statistic is count, start_time, end_time, first, last and, where the type has
them, min, max and sum. Statistics of stretches merge into the statistic of the
whole by one more aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import DataType


def statistic(kind: DataType, value: str = "value", time: str = "time", seq: str = "seq") -> list[Column]:
    """Aggregates of a series' statistic. Nulls do not count; least and greatest pass over NaN, the sum does not."""
    v, t = F.col(value), F.col(time)
    here = F.when(v.isNotNull(), t)
    order = F.when(v.isNotNull(), F.struct(t, F.col(seq)))
    out = [
        F.count(v).alias("count"), F.min(here).alias("start_time"), F.max(here).alias("end_time"),
        F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last"),
    ]
    if kind.ordered:
        real = F.when(~F.isnan(v), v) if kind.floating else v
        out += [F.min(real).alias("min"), F.max(real).alias("max"), F.sum(v.cast("double")).alias("sum")]
    elif kind is DataType.BOOLEAN:
        out.append(F.sum(v.cast("long")).alias("sum"))
    return out


def merged(kind: DataType, first_key: str, last_key: str) -> list[Column]:
    """Aggregates that merge statistics; the keys order the stretches in time. Empty stretches do nothing."""
    some = F.col("count") > 0
    out = [
        F.sum("count").alias("count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.min_by("first", F.when(some, F.col(first_key))).alias("first"), F.max_by("last", F.when(some, F.col(last_key))).alias("last"),
    ]
    if kind.ordered:
        out += [F.min("min").alias("min"), F.max("max").alias("max")]
    if kind.ordered or kind is DataType.BOOLEAN:
        out.append(F.sum("sum").alias("sum"))
    return out


def series_stats(legs: DataFrame, kind: DataType, keys: list[str]) -> DataFrame:
    return legs.groupBy(*keys).agg(*statistic(kind))


def with_pages(legs: DataFrame, keys: list[str], points: int, per_chunk: int) -> DataFrame:
    """Number the points of each series into pages of so many points, and pages into chunks."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("time", "seq")) - 1
    page = F.floor(n / points).cast("long")
    return legs.where("value is not null").withColumn("page", page).withColumn("chunk", F.floor(F.col("page") / per_chunk).cast("long"))


def page_stats(legs: DataFrame, kind: DataType, keys: list[str], points: int, per_chunk: int = 1) -> DataFrame:
    """A statistic for each page: keys, chunk, page and the fields."""
    return with_pages(legs, keys, points, per_chunk).groupBy(*keys, "chunk", "page").agg(*statistic(kind))


def merge_stats(parts: DataFrame, kind: DataType, keys: list[str], order: str) -> DataFrame:
    """Merge the statistics of stretches that ``order`` numbers."""
    return parts.groupBy(*keys).agg(*merged(kind, order, order))


def time_stats(wide: DataFrame, keys: list[str]) -> DataFrame:
    """The statistic of an aligned device's time column: every row counts."""
    return wide.groupBy(*keys).agg(F.count("time").alias("count"), F.min("time").alias("start_time"), F.max("time").alias("end_time"))
