"""The catalog of a dataset: chunks, series, devices and tables as tables of their own.

Statistics in the catalog answer counts, ranges and pruning without a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import Filter
from tidemark.functions.scalars import display_path
from tidemark.model import DataType, NotFoundError
from tidemark.operators import stats

#: Statistic fields of a chunk or series whatever its type: values as text, so that types share a table.
FIELDS = ["count", "start_time", "end_time", "first", "last", "min", "max", "sum"]


def chunk_index(stored: DataFrame, kind: DataType, points: int, per_chunk: int) -> DataFrame:
    """device, measurement, chunk and its statistic, in the series' own type, for rows with a column ``part``.

    Pages are numbered within a part (a file), so that no window holds more of a
    series than one file does; only the far fewer chunks are numbered over all.
    """
    keys = ["device", "measurement", "part"]
    pages = stats.page_stats(stored, kind, keys, points, per_chunk)
    chunks = stats.merge_stats(pages, kind, [*keys, "chunk"], "page")
    order = Window.partitionBy("device", "measurement").orderBy("start_time", "part", "chunk")
    return chunks.withColumn("chunk", (F.row_number().over(order) - 1).cast("long")).drop("part").withColumn("type", F.lit(kind.name))


def aligned_chunks(wide: DataFrame) -> list[tuple[DataType, DataFrame]]:
    """By type: device, measurement, chunk and the statistic of each column of aligned devices, by one pass over them.

    The time column is the measurement "" of type INT64; its statistic is the count of rows and their range.
    """
    names = [c for c in wide.columns if c not in ("device", "device_path", "time", "seq")]
    kinds = {m: DataType.from_spark(wide.schema[m].dataType) for m in names}
    per = [F.struct(*stats.statistic(k, f"`{m}`")).alias(f"s{i}") for i, (m, k) in enumerate(kinds.items())]
    times = F.struct(F.count("time").alias("count"), F.min("time").alias("start_time"), F.max("time").alias("end_time")).alias("times")
    found = wide.groupBy("device").agg(times, *per).persist()
    out: dict[DataType, list] = {DataType.INT64: [("", "times")]}
    for i, (m, k) in enumerate(kinds.items()):
        out.setdefault(k, []).append((m, f"s{i}"))
    made = []
    for kind, columns in out.items():
        value = kind.spark.simpleString()
        fields = {"count": "long", "start_time": "long", "end_time": "long", "first": value, "last": value}
        fields |= {"min": value, "max": value, "sum": "double"} if kind.ordered else {"sum": "long"} if kind is DataType.BOOLEAN else {}

        def row(m, c):
            have = found.schema[c].dataType.names
            return F.struct(F.lit(m).alias("measurement"), F.lit(0).cast("long").alias("chunk"), *((F.col(c)[f] if f in have else F.lit(None)).cast(t).alias(f) for f, t in fields.items()))

        made.append((kind, found.select("device", F.explode(F.array(*(row(m, c) for m, c in columns))).alias("r")).select("device", "r.*")))
    return made


def series_index(chunks: DataFrame, kind: DataType) -> DataFrame:
    """device, measurement, type, n_chunks and the statistic of the whole series."""
    merged = chunks.groupBy("device", "measurement").agg(F.count(F.lit(1)).alias("n_chunks"), *stats.merged(kind, "chunk", "chunk"))
    return merged.withColumn("type", F.lit(kind.name))


def flat(index: DataFrame) -> DataFrame:
    """An index with its values as text, so that indexes of several types can be unioned."""
    def text(c):
        if c not in index.columns:
            return F.lit(None).cast("string").alias(c)
        plain = F.col(c)
        return (F.hex(plain) if index.schema[c].dataType.typeName() == "binary" else plain.cast("string")).alias(c)

    keys = [c for c in index.columns if c not in FIELDS]
    return index.select(*keys, "count", "start_time", "end_time", *(text(c) for c in FIELDS[3:]))


def devices(index: DataFrame) -> DataFrame:
    return index.select("device").distinct()


def series_of(index: DataFrame, device: list[str]) -> DataFrame:
    """The series of a device, or an error if there is none."""
    found = index.where(F.col("device") == F.array(*map(F.lit, device)))
    if found.isEmpty():
        raise NotFoundError(f"no device {'.'.join(device)}")
    return found.orderBy("measurement")


def might_exist(index: DataFrame, device: list[str]) -> bool:
    """Whether a device may be there; the catalog's answer is exact."""
    return not index.where(F.col("device") == F.array(*map(F.lit, device))).isEmpty()


def surviving(chunks: DataFrame, flt: Filter, kind: DataType) -> DataFrame:
    """The chunks that a filter's statistic condition does not rule out."""
    return chunks.where(flt.statistic(kind))


def describe(index: DataFrame) -> DataFrame:
    """A line for each series: path, measurement, type, chunks, points and time range."""
    name = F.when(F.col("measurement") == "", F.lit("<aligned-time>")).otherwise(F.col("measurement"))
    return index.select(display_path(F.col("device")).alias("device"), name.alias("measurement"), "type", "n_chunks", F.col("count").alias("points"), "start_time", "end_time")


def totals(index: DataFrame) -> DataFrame:
    """One row: devices, measurements, chunks, points and the time range of all."""
    some = F.col("count") > 0
    return index.agg(
        F.count_distinct("device").alias("devices"), F.count(F.lit(1)).alias("measurements"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("points"), F.min(F.when(some, F.col("start_time"))).alias("min_time"), F.max(F.when(some, F.col("end_time"))).alias("max_time"),
    )


def chunks_by_type(index: DataFrame) -> DataFrame:
    return index.groupBy("type").agg(F.sum("n_chunks").alias("n_chunks"))
