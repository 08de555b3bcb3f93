"""The query surface: open a dataset, ask for measurements of devices under a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import Filter
from tidemark.model import DataType, InvalidArgError, NotFoundError, format_path, parse_path
from tidemark.operators import scan
from tidemark.sources import catalog
from tidemark.sources.store import Reader


class TsEngine:
    """Queries over one dataset."""

    def __init__(self, reader: Reader):
        self.reader = reader

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "TsEngine":
        return cls(Reader(spark, root))

    # Catalog

    def devices(self) -> DataFrame:
        return catalog.devices(self.reader.index())

    def series_of(self, device: str) -> DataFrame:
        return catalog.series_of(self.reader.index(), parse_path(device))

    def device_might_exist(self, device: str) -> bool:
        return catalog.might_exist(self.reader.index(), parse_path(device))

    def describe(self) -> DataFrame:
        return catalog.describe(self.reader.index())

    def totals(self) -> DataFrame:
        return catalog.totals(self.reader.index())

    def chunks_by_type(self) -> DataFrame:
        return catalog.chunks_by_type(self.reader.index())

    def series_chunks(self, device: str, measurement: str) -> DataFrame:
        """The chunks of one series with their statistics, in order; an error if there is no such series."""
        path = F.array(*map(F.lit, parse_path(device))).cast("array<string>")
        here = (F.col("device") == path) & (F.col("measurement") == measurement)
        kind = self.reader.index().where(here).select("type").first()
        if kind is None:
            raise NotFoundError(f"no measurement {measurement} of {device}")
        return self.reader.chunks(DataType[kind[0]]).where(here).orderBy("chunk")

    def column_meta(self, device: str, measurements: list[str]) -> list[tuple[str, DataType]]:
        df = self.query(device, measurements)
        return [(f.name, DataType.from_spark(f.dataType)) for f in df.schema if f.name not in ("device", "time", "occ")]

    # Queries

    def query(self, devices: str | list[str], measurements: list[str], flt: Filter | None = None, ordered: bool = True) -> DataFrame:
        """(device, time, occ, measurements...) of one device, or of several.

        One non-aligned measurement is a series scan, several are merged by
        time, aligned ones are a wide scan. A measurement may be asked for
        twice. Value predicates see the first measurement. Rows come by device
        and time unless ``ordered`` is false, which saves a shuffle of the result.
        """
        if not measurements:
            raise InvalidArgError("no measurements")
        paths = [parse_path(d) for d in ([devices] if isinstance(devices, str) else devices)]
        wanted = [F.array(*map(F.lit, p)).cast("array<string>") for p in paths]
        here = F.col("device").isin(wanted) if len(wanted) > 1 else F.col("device") == wanted[0]
        known = {(tuple(r["device"]), r["measurement"]): r["type"] for r in self.reader.index().where(here).select("device", "measurement", "type").collect()}  # the asked devices' series
        # The path as text reaches the scan: row groups are pruned by its range and its bloom filter.
        stored = F.col("device_path").isin([format_path(p) for p in paths])
        kinds: list[DataType] = []
        for p in paths:
            if not any(d == tuple(p) for d, _ in known):
                raise NotFoundError(f"no device {'.'.join(p)}")
            for m in measurements:
                if (tuple(p), m) not in known:
                    raise NotFoundError(f"no measurement {m} of {'.'.join(p)}")
        is_aligned = {(tuple(p), "") in known for p in paths}
        if len(is_aligned) > 1:
            raise InvalidArgError("aligned and non-aligned devices in one query")
        if is_aligned == {True}:
            return self._aligned(stored, measurements, flt, ordered)
        for m in measurements:
            found = {known[tuple(p), m] for p in paths}
            if len(found) > 1:
                raise InvalidArgError(f"measurement {m} has several types")
            kinds.append(DataType[found.pop()])
        by_type: dict[DataType, list[str]] = {}
        for k, m in zip(kinds, measurements):
            by_type.setdefault(k, []).append(m)
        tables = [(self.reader.series(k).where(stored), list(dict.fromkeys(names))) for k, names in by_type.items()]
        if len(measurements) == 1:
            m = measurements[0]
            found = scan.series(tables[0][0].where(F.col("measurement") == m), m, flt)
        else:
            found = scan.merge_long(tables, measurements, flt)
        return scan.in_order(found) if ordered else found

    def _aligned(self, here, measurements: list[str], flt: Filter | None, ordered: bool) -> DataFrame:
        found = [self.reader.aligned(n) for n in self.reader.meta["aligned"]]
        held = [w.where(here) for w in found if all(m in w.columns for m in measurements)]
        if not held:
            raise InvalidArgError("aligned and non-aligned measurements in one query")
        out = [scan.aligned(w, measurements, flt) for w in held]
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        return scan.in_order(rows) if ordered else rows

    @staticmethod
    def blocks(result: DataFrame, rows: int = 1024):
        """A result's rows in lists of bounded length, fetched a partition at a time; it may be left early."""
        held = []
        for row in result.toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == rows:
                yield held
                held = []
        if held:
            yield held

    def table(self, name: str) -> DataFrame:
        return self.reader.table(name)
