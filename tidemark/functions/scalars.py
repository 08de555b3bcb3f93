"""Scalar functions as column expressions: device paths, zigzag, varints, bit widths, hashes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The seeds of the device filter's hashes.
BLOOM_SEEDS = (5, 7, 11, 13, 31, 37, 61, 73)


# Device paths

def split_path(path: Column) -> Column:
    """Segments of an unquoted dotted path; an empty path has none."""
    return F.when(path == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(path, "[.]"))


def split_quoted_path(path: Column) -> Column:
    """Segments of a path that may quote dots with backticks; null for null, an error for an odd backtick."""
    parts = F.transform(F.split(path, r"[.](?=(?:[^`]*`[^`]*`)*+[^`]*+\z)", -1), lambda s: F.replace(s, F.lit("`"), F.lit("")))
    odd = F.length(F.regexp_replace(path, "[^`]", "")) % 2 == 1
    return F.when(odd, F.raise_error(F.concat(F.lit("odd backtick in path: "), path))).when(path == "", F.expr("cast(array() as array<string>)")).otherwise(parts)


def display_path(segments: Column) -> Column:
    """The display form of a path: segments that hold a dot are quoted."""
    return F.array_join(F.transform(segments, lambda s: F.when(F.contains(s, F.lit(".")), F.concat(F.lit("`"), s, F.lit("`"))).otherwise(s)), ".")


def table_name(segments: Column) -> Column:
    """The first segment, or null."""
    return F.get(segments, F.lit(0))


def segment_count(segments: Column) -> Column:
    return F.size(segments)


# Numbers

def zigzag(n: Column, bits: int = 64) -> Column:
    """Small numbers of either sign to small unsigned ones."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, bits - 1))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1).cast("long"))))


def bit_width(n: Column) -> Column:
    """Bits of a number as unsigned; 0 for 0, 64 for negative ones."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(bit_width(n) / 7).cast("int"))


def varint(n: Column) -> Column:
    """An unsigned 64-bit number in groups of seven bits, lowest first; every byte but the last has its top bit set."""
    size = varint_length(n)

    def octet(k):
        part = F.call_function("shiftrightunsigned", n, 7 * k).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(part + F.when(k < size - 1, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), octet), ""))


def unvarint(octets: Column) -> Column:
    """The number that ``varint`` was given, as signed 64 bits."""
    def add(total, k):
        part = F.conv(F.hex(F.substring(octets, k + 1, F.lit(1))), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long"))
        return total.bitwiseOR(F.call_function("shiftleft", part, 7 * k))

    return F.aggregate(F.sequence(F.lit(0), F.octet_length(octets) - 1), F.lit(0).cast("long"), add)


# The device filter

def murmur3(data: bytes, seed: int) -> int:
    """MurmurHash3 x86 32, which Spark's own hash equals for whole words only."""
    mask, h = 0xFFFFFFFF, seed
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    scramble = lambda k: rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotate(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def bloom_bits(entries: int, error: float) -> int:
    """Bits of a filter for so many entries: whole bytes, 64 bits at least."""
    bits = math.ceil(-entries * math.log(error) / math.log(2) ** 2)
    return (max(bits, 64) + 7) // 8 * 8


def bloom_positions(bits: int):
    """A column function: the bits that a device path sets."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def positions(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else [murmur3(p.encode(), s) % bits for s in BLOOM_SEEDS])

    return positions


def code_names(enumeration) -> Column:
    """A map from codes to names; unassigned codes are missing."""
    return F.create_map(*(F.lit(x) for m in enumeration for x in (int(m), m.name)))


