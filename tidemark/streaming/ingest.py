"""Incremental ingest: micro-batches of long rows appended to a folder, with statistics that merge.

Rows may come late and in any order: statistics fold by one aggregate, so the
catalog never needs the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import DataType
from tidemark.operators import stats

KEYS = ["device", "measurement"]


def start(stream: DataFrame, kind: DataType, data: str, partials: str, checkpoint: str, **trigger):
    """Begin appending a stream of (device, measurement, time, seq, value).

    A batch that runs again after a failure overwrites its own folder, so each
    row and each partial statistic counts once.
    """
    def commit(batch: DataFrame, number: int) -> None:
        rows = batch.where("value is not null").persist()
        rows.sortWithinPartitions(*KEYS, "time", "seq").write.mode("overwrite").parquet(f"{data}/batch={number}")
        stats.series_stats(rows, kind, KEYS).withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{partials}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def folded(partials: DataFrame, kind: DataType) -> DataFrame:
    """The statistic of every series from its batches' statistics, whatever order they came in.

    first is from the batch whose part starts first, last from the one whose
    part ends last; the later batch wins a tie.
    """
    merged = stats.merged(kind, "start_time", "end_time")
    ordered = partials.withColumn("_from", F.struct("start_time", "batch_no")).withColumn("_to", F.struct("end_time", "batch_no"))
    fields = [c for c in merged]
    fields[3] = F.min_by("first", "_from").alias("first")
    fields[4] = F.max_by("last", "_to").alias("last")
    return ordered.groupBy(*KEYS).agg(*fields)
