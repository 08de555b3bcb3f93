"""The classic series encodings as relations: what each stores, and how to get the values back.

Bytes, blocks and pages are Parquet's. These functions give the row-visible
transforms, for analysis and for size estimates: differences of differences,
XOR with the value before, runs, dictionary ids, zigzag, and the widths of
bit-packed blocks. Differences wrap around in 64 bits; Spark's arithmetic must
be told so (``wrapping``), as its ANSI mode raises on overflow.

Every function keeps the key columns and works within a series, in the order
(time, seq); decoding is a running aggregate over the same window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import bit_width, unzigzag, varint_length, zigzag
from tidemark.model import DataType, UnsupportedError

#: Values of a packed block.
BLOCK = 128
_TWO64 = "18446744073709551616"
_TWO63 = "9223372036854775808"


def wrapping(total: Column) -> Column:
    """A decimal whole number as signed 64 bits, wrapped around."""
    shifted = (total + F.lit(_TWO63).cast("decimal(38,0)"))
    low = F.pmod(shifted, F.lit(_TWO64).cast("decimal(38,0)")) - F.lit(_TWO63).cast("decimal(38,0)")
    return low.cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _difference(a: Column, b: Column) -> Column:
    """a - b in 64 bits; only what overflows takes the way through decimals."""
    return F.coalesce(F.try_subtract(a, b), wrapping(_wide(a) - _wide(b)))


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("time", "seq")


def _wrap32(n: Column) -> Column:
    """A whole number as signed 32 bits, wrapped around."""
    return ((n + F.lit(1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")


@F.pandas_udf(T.LongType())
def double_bits(values: pd.Series) -> pd.Series:
    """The bits of a double as a whole number; every NaN, and null, as the canonical NaN."""
    found = values.to_numpy(dtype="float64", na_value=np.nan)
    return pd.Series(np.where(np.isnan(found), np.int64(0x7FF8000000000000), found.view(np.int64)))


@F.pandas_udf(T.DoubleType())
def double_of_bits(bits: pd.Series) -> pd.Series:
    """The double with these bits."""
    return pd.Series(bits.to_numpy(dtype="int64").view(np.float64))


@F.pandas_udf(T.IntegerType())
def float_bits(values: pd.Series) -> pd.Series:
    """The bits of a float as a whole number of 32 bits; every NaN, and null, as the canonical NaN."""
    found = values.to_numpy(dtype="float32", na_value=np.nan)
    return pd.Series(np.where(np.isnan(found), np.int32(0x7FC00000), found.view(np.int32)))


@F.pandas_udf(T.FloatType())
def float_of_bits(bits: pd.Series) -> pd.Series:
    """The float with these bits."""
    return pd.Series(bits.to_numpy(dtype="int32").view(np.float32))


def _kind(legs: DataFrame, value: str) -> DataType:
    kind = DataType.from_spark(legs.schema[value].dataType)
    if kind not in (DataType.INT32, DataType.INT64, DataType.FLOAT, DataType.DOUBLE):
        raise UnsupportedError(f"no differences of {kind.name}")
    return kind


def with_bits(legs: DataFrame, value: str = "value", out: str = "bits") -> DataFrame:
    """Add a number's bits as a whole number of its own width: 32 or 64."""
    kind = _kind(legs, value)
    return legs.withColumn(out, {DataType.FLOAT: float_bits, DataType.DOUBLE: double_bits}.get(kind, F.col)(value))


def of_bits(bits: str, kind: DataType) -> Column:
    """The number with these bits."""
    return {DataType.FLOAT: float_of_bits, DataType.DOUBLE: double_of_bits}.get(kind, F.col)(bits)


def _narrow(kind: DataType) -> bool:
    return kind in (DataType.INT32, DataType.FLOAT)


def ts2diff(legs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """first, delta and delta_of_delta; null where there is no value before.

    Whole numbers are taken as they are and floating ones by their bits, each
    in its own width, in which differences wrap around.
    """
    w, narrow = _order(keys), _narrow(_kind(legs, value))
    minus = (lambda a, b: _wrap32(a.cast("long") - b.cast("long"))) if narrow else _difference
    rows = with_bits(legs, value, "_bits")
    rows = rows.withColumn("_before", F.lag("_bits").over(w)).withColumn("delta", minus(F.col("_bits"), F.col("_before")))
    rows = rows.withColumn("_before", F.lag("delta").over(w))
    second = minus(F.col("delta"), F.col("_before"))
    first = F.when(F.row_number().over(w) == 1, F.col("_bits"))
    return rows.withColumn("first", first).withColumn("delta_of_delta", second).drop("_before", "_bits")


def _summed(c: Column, w, narrow: bool) -> Column:
    return _wrap32(F.sum(c.cast("long")).over(w)) if narrow else wrapping(F.sum(c.cast("decimal(28,0)")).over(w))


def ts2diff_decode(coded: DataFrame, keys: list[str], kind: DataType = DataType.INT64) -> DataFrame:
    """``value`` again from what is stored: the first value, the first delta and the differences of deltas. Both sums wrap."""
    w, narrow = _order(keys).rowsBetween(Window.unboundedPreceding, 0), _narrow(kind)
    step = F.when(F.col("first").isNull(), F.coalesce("delta_of_delta", "delta"))
    rows = coded.withColumn("_step", F.coalesce(_summed(F.coalesce(step, F.lit(0)), w, narrow), F.lit(0)))
    rows = rows.withColumn("_bits", _summed(F.coalesce("first", "_step"), w, narrow))
    return rows.withColumn("value", of_bits("_bits", kind)).drop("_step", "_bits")


def xor_previous(legs: DataFrame, keys: list[str], bits: str = "bits") -> DataFrame:
    """``xor``: the bits against those before; the first row has its own bits."""
    before = F.lag(bits).over(_order(keys))
    return legs.withColumn("xor", F.when(before.isNull(), F.col(bits)).otherwise(F.col(bits).bitwiseXOR(before)))


def xor_decode(coded: DataFrame, keys: list[str]) -> DataFrame:
    """``bits`` again: each bit is the parity of the bits so far, so runs over the positions of a window."""
    narrow = coded.schema["xor"].dataType == T.IntegerType()
    w = _order(keys).rowsBetween(Window.unboundedPreceding, 0)
    wide = F.col("xor").cast("long")
    parity = [F.shiftleft(F.sum(F.shiftrightunsigned(wide, k).bitwiseAND(F.lit(1).cast("long"))).over(w).bitwiseAND(F.lit(1).cast("long")), k) for k in range(32 if narrow else 64)]
    bits = parity[0]
    for p in parity[1:]:
        bits = bits.bitwiseOR(p)
    return coded.withColumn("bits", _wrap32(bits) if narrow else bits)


def rle(legs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Runs of equal values: keys, run, value, length, start_time, end_time."""
    w = _order(keys)
    fresh = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long"), F.lit(1))
    fresh = F.when(F.row_number().over(w) == 1, 1).otherwise(fresh)
    rows = legs.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("length"), F.min("time").alias("start_time"), F.max("time").alias("end_time"))


def rle_decode(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The values again, with their place in the series."""
    w = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_before", F.coalesce(F.sum("length").over(w), F.lit(0)))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    return rows.select(*keys, (F.col("_before") + F.col("_k")).alias("seq"), "value")


def dictionary(legs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Ids of the distinct values of each series, in the order they first appear: keys, id, value, uses."""
    seen = legs.groupBy(*keys, value).agg(F.min(F.struct("time", "seq")).alias("_first"), F.count(F.lit(1)).alias("uses"))
    w = Window.partitionBy(*keys).orderBy("_first")
    return seen.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("id"), F.col(value).alias("value"), "uses")


def dictionary_encode(legs: DataFrame, entries: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    ids = entries.select(*keys, F.col("id"), F.col("value").alias("_value"))
    on = [legs[k].eqNullSafe(ids[k]) for k in keys] + [legs[value].eqNullSafe(ids["_value"])]
    out = legs.join(ids, on).drop(*(ids[k] for k in keys))
    return out.drop("_value", value)


def dictionary_decode(coded: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    return coded.join(entries.select(*keys, "id", "value"), [*keys, "id"]).drop("id")


def zigzag_bytes(legs: DataFrame, value: str = "value") -> DataFrame:
    """zigzag and its varint's length."""
    return legs.withColumn("zigzag", zigzag(F.col(value).cast("long"))).withColumn("n_bytes", varint_length(F.col("zigzag")))


def packed_blocks(legs: DataFrame, keys: list[str], value: str, size: int = BLOCK) -> DataFrame:
    """Blocks of bit-packed numbers: keys, block, n, width (of the widest) and n_bits."""
    n = F.row_number().over(_order(keys)) - 1
    rows = legs.withColumn("block", F.floor(n / size).cast("long"))
    blocks = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.max(bit_width(F.col(value))).alias("width"))
    return blocks.withColumn("n_bits", F.col("n") * F.col("width"))


def pack(legs: DataFrame, keys: list[str], value: str, size: int = BLOCK) -> DataFrame:
    """Blocks of numbers packed in as many bits each as the widest needs: keys, block, n, width and packed.

    Numbers are unsigned 64 bits, highest bit first; the last byte is filled with zeros.
    """
    n = F.row_number().over(_order(keys)) - 1
    rows = legs.withColumn("block", F.floor(n / size).cast("long")).withColumn("_k", n)
    blocks = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_k", F.col(value).cast("long").alias("v")))).alias("_held"), F.max(bit_width(F.col(value))).alias("width"))
    bits = F.array_join(F.transform("_held", lambda x: F.lpad(F.bin(x["v"]), F.col("width"), "0")), "")
    blocks = blocks.withColumn("n", F.size("_held").cast("long")).withColumn("_bits", bits)
    octets = F.ceil(F.length("_bits") / 8).cast("int")
    digit = lambda k: F.lpad(F.conv(F.rpad(F.substring("_bits", 8 * k + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0")
    packed = F.when(octets > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), octets - 1), digit), ""))).otherwise(F.lit(b""))
    return blocks.select(*keys, "block", "n", "width", packed.alias("packed"))


def unpack(blocks: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """The numbers of packed blocks again: keys, seq (the place in the series) and value."""
    octet = lambda k: F.lpad(F.conv(F.hex(F.substring("packed", k + 1, F.lit(1))), 16, 2), 8, "0")
    rows = blocks.withColumn("_bits", F.when(F.octet_length("packed") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length("packed") - 1), octet), "")).otherwise(""))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    found = F.substring("_bits", (F.col("_k") * F.col("width") + 1).cast("int"), F.col("width"))
    value = F.when(F.col("width") == 0, F.lit(0).cast("long")).otherwise(wrapping(F.conv(found, 2, 10).cast("decimal(20,0)")))
    return rows.select(*keys, (F.col("block") * size + F.col("_k")).alias("seq"), value.alias("value"))


def _second_order(legs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """zigzagged differences of differences as ``_zz``, from the third value on."""
    coded = ts2diff(legs, keys, value)
    return coded.where("delta_of_delta is not null").withColumn("_zz", zigzag(F.col("delta_of_delta").cast("long")))


def sprintz_blocks(legs: DataFrame, keys: list[str], value: str = "value", size: int = BLOCK) -> DataFrame:
    """Packed blocks of the zigzagged differences of differences; the first value stands alone."""
    coded = ts2diff(legs, keys, value)
    rest = coded.withColumn("_zz", zigzag(F.coalesce("delta_of_delta", "delta").cast("long"))).where("delta is not null")
    return packed_blocks(rest, keys, "_zz", size)


def sprintz(legs: DataFrame, keys: list[str], value: str = "value", size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What is stored of each series: its first value and delta (keys, first, delta), and packed blocks of the rest."""
    coded = ts2diff(legs, keys, value).withColumn("_n", F.row_number().over(_order(keys)))
    heads = coded.where("_n <= 2").groupBy(*keys).agg(F.max("first").alias("first"), F.max("delta").alias("delta"))
    return heads, pack(_second_order(legs, keys, value), keys, "_zz", size)


def sprintz_decode(heads: DataFrame, blocks: DataFrame, keys: list[str], kind: DataType, size: int = BLOCK) -> DataFrame:
    """The values again: keys, seq (the place in the series) and value."""
    number = "int" if _narrow(kind) else "bigint"
    none = F.lit(None).cast(number)
    first = heads.select(*keys, F.lit(0).cast("long").alias("seq"), "first", none.alias("delta"), none.alias("delta_of_delta"))
    second = heads.where("delta is not null").select(*keys, F.lit(1).cast("long").alias("seq"), none.alias("first"), "delta", none.alias("delta_of_delta"))
    rest = unpack(blocks, keys, size).select(*keys, (F.col("seq") + 2).alias("seq"), none.alias("first"), none.alias("delta"), unzigzag(F.col("value")).cast(number).alias("delta_of_delta"))
    coded = first.unionByName(second).unionByName(rest).withColumn("time", F.col("seq"))
    return ts2diff_decode(coded, keys, kind).select(*keys, "seq", "value")


def plain_bytes(kind: DataType, value: str = "value") -> Column:
    """Bytes of a value stored plainly: fixed width, or a four-byte length and the bytes."""
    fixed = {DataType.BOOLEAN: 1, DataType.INT32: 4, DataType.INT64: 8, DataType.FLOAT: 4, DataType.DOUBLE: 8}
    return F.lit(fixed[kind]) if kind in fixed else F.octet_length(F.col(value)) + 4
