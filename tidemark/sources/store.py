"""Datasets on disk: Parquet folders for series by type, aligned devices and tables, with a catalog.

    <root>/meta                           the marker: a JSON line for each commit; the last one names the folders that count
    <root>/series/type=<T>/<commit>       device, device_path, measurement, time, seq, value
    <root>/aligned/<name>/<commit>        device, device_path, time, seq, columns
    <root>/tables/<name>/<commit>         time, tag and field columns; the schema is in the files
    <root>/catalog/type=<T>/<commit>      chunk statistics of series and of aligned columns, which include the time column ("")

A commit writes folders of its own and then its line of the marker, so that a
failed one leaves the dataset as it was, and no commit reads what others wrote.

Rows are sorted by (device, measurement, time, seq) in files, so that row-group
and page statistics prune by device and time, and a bloom filter on the path
answers whether a device is there.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import display_path, split_quoted_path
from tidemark.model import Category, Config, CorruptedError, DataType, InvalidArgError, Measurement, NotFoundError, Record, Registry, TableSchema, Tablet, TypeMismatchError, UnsupportedError, parse_path
from tidemark.sources import catalog

MAGIC = "tidemark"
VERSION = 2
#: What a commit may add to, and where it is kept.
FOLDERS = {"series": "series/type={}", "aligned": "aligned/{}", "tables": "tables/{}", "chunks": "catalog/type={}"}
PARTS = tuple(FOLDERS)


def _path(path: str):
    return F.array(*map(F.lit, parse_path(path))).cast("array<string>")


class Writer:
    """Collects validated rows and commits them to a dataset.

    Records and tablets come from the caller's own process and are small; data
    that is already distributed goes in by ``write_series`` and
    ``write_aligned`` and never passes through the driver.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, mode: str = "overwrite"):
        self.spark, self.root, self.config, self.registry = spark, root.rstrip("/"), config or Config(), Registry()
        self._tables: dict[str, TableSchema] = {}
        self._aligned_schemas: dict[str, dict[str, Measurement]] = {}
        self._legs: dict[DataType, list] = {}
        self._aligned: dict[str, list] = {}
        self._frames: dict[DataType, list[DataFrame]] = {}
        self._aligned_frames: dict[str, list[DataFrame]] = {}
        self._table_frames: dict[str, list[DataFrame]] = {}
        self._seq, self._mode, self._closed, self._held = 0, mode, False, 0

    # Registration

    def register(self, device: str, measurement: Measurement) -> None:
        """The first registration of a measurement stays."""
        self.registry.register(device, measurement)

    def register_aligned(self, device: str, measurements: list[Measurement]) -> None:
        known = self._aligned_schemas.setdefault(device, {})
        for m in measurements:
            known.setdefault(m.name, m)

    def register_table(self, schema: TableSchema) -> None:
        self._tables[schema.name] = schema

    # Rows

    def _next(self) -> int:
        if self._closed:
            raise InvalidArgError("the writer is closed")
        self._seq += 1
        return self._seq

    def _hold(self, values) -> None:
        """Count what is held; beyond a group's size it is flushed."""
        self._held += sum(16 + (len(v) if isinstance(v, (str, bytes)) else 8) for v in values)
        if self._held >= self.config.group_bytes:
            self.flush()

    def write_record(self, record: Record) -> None:
        """Non-aligned values; nulls leave no row, names must be registered."""
        wanted = [(p, self.registry.need(record.device, p.name)) for p in record.points if p.type is not None]
        for p, m in wanted:
            if p.type is not m.type and not (p.type is DataType.STRING and m.type is DataType.TEXT):
                raise TypeMismatchError(m.type, p.type)
        seq = self._next()
        for p, m in wanted:
            value = p.value.encode() if m.type is DataType.TEXT and isinstance(p.value, str) else p.value
            self._legs.setdefault(m.type, []).append((parse_path(record.device), p.name, record.time, seq, value))
        self._hold(p.value for p, _ in wanted)

    def write_tablet(self, tablet: Tablet) -> None:
        """Non-aligned columns; the tablet's own schemas register on the way, null cells leave no row."""
        for m in tablet.columns:
            self.registry.register(tablet.device, m)
        device = parse_path(tablet.device)
        for row in tablet.rows():
            seq = self._next()
            for m, value in zip(tablet.columns, row[1:]):
                known = self.registry.need(tablet.device, m.name)
                if known.type is not m.type:
                    raise TypeMismatchError(known.type, m.type)
                if value is not None:
                    self._legs.setdefault(m.type, []).append((device, m.name, row[0], seq, value))
            self._hold(v for v in row[1:] if v is not None)

    def write_aligned_record(self, record: Record) -> None:
        """One row of an aligned device; registered columns that the record leaves out are null."""
        known = self._aligned_schemas.get(record.device, {})
        for p in record.points:
            if p.name not in known:
                raise NotFoundError(f"measurement {p.name} of {record.device} is not registered")
        record.check_types({n: m.type for n, m in known.items()})
        values = {p.name: p.value for p in record.points}
        self._aligned.setdefault(record.device, []).append((record.time, self._next(), values))
        self._hold(v for v in values.values() if v is not None)

    def write_series(self, df: DataFrame, kind: DataType) -> None:
        """A distributed long table: device (path or segments), measurement, time, seq, value."""
        if DataType.from_spark(df.schema["value"].dataType) is not kind:
            raise TypeMismatchError(kind, DataType.from_spark(df.schema["value"].dataType))
        self._frames.setdefault(kind, []).append(df)

    def write_wide(self, df: DataFrame, measurements: list[str]) -> None:
        """A distributed wide table of non-aligned series: device, time, seq and columns; nulls leave no row."""
        by_type: dict[DataType, list[str]] = {}
        for m in measurements:
            by_type.setdefault(DataType.from_spark(df.schema[m].dataType), []).append(m)
        for kind, names in by_type.items():
            self.write_series(unpivoted(df, names), kind)

    def write_aligned(self, name: str, df: DataFrame) -> None:
        """A distributed wide table of aligned devices: device, time, seq and nullable columns."""
        self._aligned_frames.setdefault(name, []).append(df)

    def write_table(self, name: str, df: DataFrame) -> None:
        """Rows of a registered table; tags identify, fields are values."""
        schema = self._tables.get(name)
        if schema is None:
            raise NotFoundError(f"table {name} is not registered")
        for c in schema.columns:
            if c.name not in df.columns:
                raise NotFoundError(f"column {c.name} of {name}")
            actual = DataType.from_spark(df.schema[c.name].dataType)
            if actual is not c.type:
                raise TypeMismatchError(c.type, actual)
        self._table_frames.setdefault(name, []).append(df)

    # Commit

    def _out(self, df: DataFrame, *where: str) -> str:
        path = "/".join([self.root, *where])
        writer = df.write
        for k, v in self.config.parquet_options().items():
            writer = writer.option(k, v)
        writer.parquet(path)
        return path

    def close(self) -> None:
        """Commit what is left and end the writer."""
        self.flush()
        self._closed = True

    def flush(self) -> None:
        """Commit all that was collected, its catalog and the marker; later rows append to it."""
        if self._closed:
            raise InvalidArgError("the writer is closed")
        self._commit()
        self._legs, self._aligned, self._frames, self._aligned_frames, self._table_frames = {}, {}, {}, {}, {}
        self._mode, self._held = "append", 0

    def _commit(self) -> None:
        try:
            before = read_meta(self.spark, self.root)
        except (NotFoundError, CorruptedError):
            before = {"number": 0}
        fresh = self._mode != "append"
        meta = {"magic": MAGIC, "version": VERSION, "number": before["number"] + 1} | {k: {} if fresh else {n: list(c) for n, c in before.get(k, {}).items()} for k in PARTS}
        commit = f"{meta['number']:06d}-{uuid.uuid4().hex[:8]}"

        def stored(part: str, name: str, label: str, df: DataFrame) -> DataFrame:
            path = self._out(df, FOLDERS[part].format(name), label)
            meta[part].setdefault(name, []).append(label)
            return self.spark.read.parquet(path)

        number = F.lit(meta["number"]).alias("commit")
        for kind in {**self._legs, **self._frames}:
            parts = [_segments(f) for f in self._frames.get(kind, [])]
            if kind in self._legs:
                struct = f"device array<string>, measurement string, time long, seq long, value {kind.spark.simpleString()}"
                parts.append(self.spark.createDataFrame(self._legs[kind], struct))
            rows = reduce(DataFrame.unionByName, (p.select("device", "measurement", "time", "seq", "value") for p in parts)).where("value is not null")
            rows = rows.withColumn("device_path", display_path(F.col("device")))
            # Ranges keep a device's rows together and split one that is too large for a task.
            rows = rows.repartitionByRange("device", "measurement", "time", "seq").sortWithinPartitions("device", "measurement", "time", "seq")
            found = stored("series", kind.name, commit, rows).withColumn("part", F.col("_metadata.file_name"))
            chunks = catalog.chunk_index(found, kind, self.config.page_points, 8).drop("type")
            stored("chunks", kind.name, commit, chunks.select("*", number))
        for device, known in self._aligned_schemas.items():
            rows = self._aligned.get(device, [])
            if not rows and not fresh:
                continue
            columns = sorted(known)
            struct = "device array<string>, time long, seq long, " + ", ".join(f"`{c}` {known[c].type.spark.simpleString()}" for c in columns)
            data = [(parse_path(device), t, seq, *(values.get(c) for c in columns)) for t, seq, values in rows]
            self._aligned_frames.setdefault(device.replace("/", "_"), []).append(self.spark.createDataFrame(data, struct))
        for k, (name, frames) in enumerate(self._aligned_frames.items()):
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(_segments, frames))
            rows = rows.withColumn("device_path", display_path(F.col("device")))
            found = stored("aligned", name, commit, rows.repartitionByRange("device", "time", "seq").sortWithinPartitions("device", "time", "seq"))
            for kind, chunks in catalog.aligned_chunks(found):
                stored("chunks", kind.name, f"{commit}-{k}", chunks.select("*", number))
        for name, schema in self._tables.items():
            frames = self._table_frames.get(name, [])
            if not frames and name in meta["tables"]:
                continue
            order = [c.name for c in schema.columns if c.category is Category.TAG] + ["time"]
            names = ["time", *(c.name for c in schema.columns)]
            empty = self.spark.createDataFrame([], schema.struct())
            rows = reduce(DataFrame.unionByName, (f.select(*names) for f in frames), empty)
            rows = rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.struct()))
            stored("tables", name, commit, rows.repartitionByRange(*order).sortWithinPartitions(*order))
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/meta")
        if fresh:
            self._drop(before)

    def _drop(self, before: dict) -> None:
        """Remove the folders of a dataset that this one has replaced."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for part in PARTS:
            for name, commits in before.get(part, {}).items():
                for c in commits:
                    at = jvm.org.apache.hadoop.fs.Path("/".join([self.root, FOLDERS[part].format(name), c]))
                    at.getFileSystem(conf).delete(at, True)


def _segments(df: DataFrame) -> DataFrame:
    """The device as segments, if it is given as a path, which may quote dots."""
    if df.schema["device"].dataType.typeName() != "array":
        df = df.withColumn("device", split_quoted_path(F.col("device")))
    return df


def unpivoted(df: DataFrame, measurements: list[str], value: str = "value") -> DataFrame:
    """Wide columns of one type as long rows, without nulls."""
    ids = [c for c in ("device", "time", "seq") if c in df.columns]
    return df.unpivot([F.col(c) for c in ids], [F.col(f"`{m}`") for m in measurements], "measurement", value).where(F.col(value).isNotNull())


def read_meta(spark: SparkSession, root: str) -> dict:
    """The last line of a dataset's marker; an error if there is none or it is of another kind or version."""
    try:
        lines = spark.read.text(f"{root}/meta").collect()  # a line for each commit
    except AnalysisException:
        raise NotFoundError(f"no dataset at {root}") from None
    try:
        found = [json.loads(r[0]) for r in lines]
        meta = max(found, key=lambda m: m.get("number", 0))
    except (ValueError, AttributeError):
        raise CorruptedError(f"unreadable marker of {root}") from None
    if meta.get("magic") != MAGIC:
        raise CorruptedError(f"{root} holds no dataset of this engine")
    if meta.get("version") != VERSION:
        raise UnsupportedError(f"version {meta.get('version')}")
    return meta


class Reader:
    """A dataset's tables and catalog, as they were when it was opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.meta = read_meta(spark, self.root)
        self._index: DataFrame | None = None

    @property
    def types(self) -> list[DataType]:
        return [DataType[t] for t in self.meta["series"]]

    def _read(self, part: str, name: str) -> DataFrame:
        paths = ["/".join([self.root, FOLDERS[part].format(name), c]) for c in self.meta[part][name]]
        return self.spark.read.option("mergeSchema", str(part == "aligned" and len(paths) > 1).lower()).parquet(*paths)

    def series(self, kind: DataType) -> DataFrame:
        return self._read("series", kind.name)

    def aligned(self, name: str) -> DataFrame:
        return self._read("aligned", name)

    def table(self, name: str) -> DataFrame:
        if name not in self.meta["tables"]:
            raise NotFoundError(f"no table {name}")
        return self._read("tables", name)

    def table_schema(self, name: str) -> TableSchema:
        return TableSchema.from_struct(name, self.table(name).schema)

    def chunks(self, kind: DataType) -> DataFrame:
        """device, measurement, chunk and its statistic; chunks of all commits are numbered by their start."""
        order = Window.partitionBy("device", "measurement").orderBy("start_time", "commit", "chunk")
        return self._read("chunks", kind.name).withColumn("chunk", (F.row_number().over(order) - 1).cast("long")).drop("commit")

    def index(self) -> DataFrame:
        """All series: device, measurement, type, n_chunks and the statistic with values as text.

        It is merged from the stored chunk statistics; no data are read. Cached: it is small next to the data.
        """
        if self._index is None:
            struct = "device array<string>, measurement string, type string, n_chunks long, count long, start_time long, end_time long, first string, last string, min string, max string, sum string"
            parts = [self.spark.createDataFrame([], struct)]
            parts += [catalog.flat(catalog.series_index(self.chunks(k), k)) for k in map(DataType.__getitem__, self.meta["chunks"])]
            self._index = reduce(DataFrame.unionByName, (p.select(*parts[0].columns) for p in parts)).cache()
        return self._index
