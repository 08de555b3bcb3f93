"""Helpers shared by the operators: tables, the shared folder, hot keys, workers' memory."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' words: space and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"

_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder, and a cluster a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _local_scratch:
        _local_scratch.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _local_scratch[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``written`` made and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write to the shared folder and read again, which cuts the lineage.

    Lost executors then cost no more than the tasks they ran. The path comes
    with the table, so that a caller can drop it early; else the JVM drops it
    when it ends, whether the session was stopped before or not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """The tables that one computation writes; ``end`` drops those that nothing reads any more."""

    def __init__(self):
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = written(df)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self._paths.pop(id(t))
            drop_path(t.sparkSession, path)
        if tables:  # Spark's cleaner removes a finished plan's shuffle files once the driver has collected the plan
            tables[0].sparkSession.sparkContext._jvm.System.gc()

    def end(self, *still_read: DataFrame) -> None:
        self.drop(*(t for k, (t, _) in list(self._paths.items()) if k not in set(map(id, still_read))))


# Hot keys

#: Keys that are dealt to several parts, at most; the list of them is what a join by ``join_dealt`` broadcasts.
HOT_KEYS = 100_000
#: Rows of a key that one part may hold, at least.
LEAST_PART = 1000


def join_dealt(rows: DataFrame, side: DataFrame, keys: list[str], counts: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each key, with hot keys dealt to several parts.

    ``counts`` has the keys and ``n``, the rows of each (at least; keys may be
    missing that have few). A key of more rows than a part may hold has its
    rows dealt by ``spread``, and its row of ``side`` repeated for each part. A
    part holds LEAST_PART rows or a HOT_KEYS-th of all, whichever is more, so
    no more than HOT_KEYS keys can be hot, whatever the data. Keys aren't null.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    part = max(LEAST_PART, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= part:
        return rows.join(side.hint("merge"), keys, how)
    hot = F.broadcast(counts.where(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = side.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right.hint("merge"), [*keys, "_part"], how).drop("_part")


# Workers

#: Bytes of text, and of 64 more for each row, that a worker takes in hand at once; one text may hold more.
PART_BYTES = 1 << 20


def parts(batches, column: int, most: int = PART_BYTES):
    """Record batches cut so that a string or binary column holds about so many bytes in each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def frugal(run):
    """A worker's function over batches that gives unused memory back at its end, as workers outlive their tasks."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
