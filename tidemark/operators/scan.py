"""Scans of series and aligned devices, and the time-aligned merge of many series.

Series are long tables (device, time, seq, value); aligned devices are wide
ones (device, time, seq, m1, ..., mN). ``seq`` is the order of insertion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import Filter
from tidemark.model import DataType, InvalidArgError


def output_names(measurements: list[str]) -> list[str]:
    """Measurement names as column names; repeats get _2, _3 and so on."""
    out: list[str] = []
    for m in measurements:
        name, k = m, 1
        while name in out:
            k += 1
            name = f"{m}_{k}"
        out.append(name)
    return out


def _where(df: DataFrame, flt: Filter | None, first: str) -> DataFrame:
    """Rows that pass, where value predicates see the first projected column."""
    if flt is None:
        return df
    kind = DataType.from_spark(df.schema[first].dataType)
    return df.where(flt.row(F.col("time"), F.col(f"`{first}`"), kind))


def series(legs: DataFrame, measurement: str, flt: Filter | None = None) -> DataFrame:
    """One series: (device, time, seq, measurement). Its rows hold no nulls."""
    df = legs.where("value is not null").select("device", "time", "seq", F.col("value").alias(measurement))
    return _where(df, flt, measurement)


def aligned(wide: DataFrame, measurements: list[str], flt: Filter | None = None) -> DataFrame:
    """Columns of an aligned device. Nulls stay, and so do rows whose chosen columns are all null."""
    if not measurements:
        raise InvalidArgError("no measurements")
    names = output_names(measurements)
    df = wide.select("device", "time", "seq", *(F.col(f"`{m}`").alias(n) for m, n in zip(measurements, names)))
    return _where(df, flt, names[0])


def merge(legs: list[DataFrame], measurements: list[str], flt: Filter | None = None) -> DataFrame:
    """All legs' rows by (device, time, occ): one column for each leg, null where a leg has no such row.

    The n-th row that a leg has at a time meets the n-th rows of the others.
    Legs are unioned and dealt once by (device, time); the window and the
    aggregate both keep that dealing, so any number of legs costs one shuffle.
    Time predicates go below it; value predicates see the first column and stay
    above. Each leg keeps its own type.
    """
    if not legs or len(legs) != len(measurements):
        raise InvalidArgError("as many series as measurements are needed, and one at least")
    parts = []
    for k, leg in enumerate(legs):
        own = [(F.col("value") if j == k else F.lit(None).cast(legs[j].schema["value"].dataType)).alias(f"v{j}") for j in range(len(legs))]
        parts.append(leg.where("value is not null").select("device", "time", "seq", F.lit(k).alias("leg"), *own))
    return _merged(reduce(DataFrame.unionByName, parts), output_names(measurements), flt)


def merge_long(tables: list[tuple[DataFrame, list[str]]], measurements: list[str], flt: Filter | None = None) -> DataFrame:
    """``merge`` of series that long tables hold: (device, measurement, time, seq, value) each, with the measurements to take from it.

    Each table is scanned once, however many of its series are merged; a
    measurement that is asked for twice is one leg, and its column is repeated.
    """
    wanted = list(dict.fromkeys(measurements))
    if not wanted:
        raise InvalidArgError("no measurements")
    kinds = {m: t.schema["value"].dataType for t, names in tables for m in names}
    parts = []
    for table, names in tables:
        leg = F.element_at(F.create_map(*(F.lit(x) for m in names for x in (m, wanted.index(m)))), F.col("measurement"))
        own = [(F.when(F.col("measurement") == m, F.col("value")) if m in names else F.lit(None).cast(kinds[m])).alias(f"v{k}") for k, m in enumerate(wanted)]
        parts.append(table.where(F.col("measurement").isin(*names) & F.col("value").isNotNull()).select("device", "time", "seq", leg.alias("leg"), *own))
    merged = _merged(reduce(DataFrame.unionByName, parts), output_names(wanted), flt)
    columns = [F.col(f"`{m}`").alias(n) for m, n in zip(measurements, output_names(measurements))]
    return merged.select("device", "time", "occ", *columns)


def _merged(rows: DataFrame, names: list[str], flt: Filter | None) -> DataFrame:
    below = flt.time_only(F.col("time")) if flt is not None else None
    rows = rows if below is None else rows.where(below)
    rows = rows.repartition("device", "time") if len(names) > 1 else rows
    occ = F.row_number().over(Window.partitionBy("device", "time", "leg").orderBy("seq"))
    # A leg has one row for each (device, time, occ), and no nulls: the first value that is not null is that row's.
    values = [F.first(f"v{k}", ignorenulls=True).alias(n) for k, n in enumerate(names)]
    merged = rows.withColumn("occ", occ).groupBy("device", "time", "occ").agg(*values)
    return _where(merged, flt, names[0])


def in_order(df: DataFrame) -> DataFrame:
    """Rows by device (segment by segment), time and occurrence."""
    last = [c for c in ("occ", "seq") if c in df.columns]
    return df.orderBy("device", "time", *last)
