"""Types, errors, device paths, schemas, records and batches of the time-series model."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

import numpy as np
from pyspark.sql import types as T


# Errors

class TsError(Exception):
    """Base of all errors that the engine raises on purpose."""


class IoError(TsError):
    pass


class OutOfMemoryError(TsError):
    pass


class CorruptedError(TsError):
    pass


class TypeMismatchError(TsError):
    def __init__(self, expected: "DataType", actual: "DataType"):
        super().__init__(f"expected {expected.name}, got {actual.name}")
        self.expected, self.actual = expected, actual


class OutOfOrderError(TsError):
    pass


class EncodingError(TsError):
    pass


class CompressionError(TsError):
    pass


class NotFoundError(TsError):
    pass


class InvalidArgError(TsError):
    pass


class UnsupportedError(TsError):
    pass


# Enumerations

class _Coded(IntEnum):
    @classmethod
    def of(cls, code):
        """The member with a code, or an error for codes that are not assigned."""
        try:
            return cls(code)
        except ValueError:
            raise InvalidArgError(f"unknown {cls.__name__} code: {code}") from None


class DataType(_Coded):
    BOOLEAN = 0
    INT32 = 1
    INT64 = 2
    FLOAT = 3
    DOUBLE = 4
    TEXT = 5
    STRING = 6

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @classmethod
    def from_spark(cls, kind: T.DataType) -> "DataType":
        for ours, theirs in _SPARK.items():
            if type(theirs) is type(kind):
                return ours
        raise UnsupportedError(f"no series type for {kind.simpleString()}")

    @property
    def ordered(self) -> bool:
        """Whether statistics hold a least and a greatest value."""
        return self in (DataType.INT32, DataType.INT64, DataType.FLOAT, DataType.DOUBLE)

    @property
    def floating(self) -> bool:
        return self in (DataType.FLOAT, DataType.DOUBLE)


_SPARK = {
    DataType.BOOLEAN: T.BooleanType(), DataType.INT32: T.IntegerType(), DataType.INT64: T.LongType(), DataType.FLOAT: T.FloatType(),
    DataType.DOUBLE: T.DoubleType(), DataType.TEXT: T.BinaryType(), DataType.STRING: T.StringType(),
}


class Encoding(_Coded):
    PLAIN = 0
    DICTIONARY = 1
    RLE = 2
    TS_2DIFF = 4
    GORILLA = 8
    ZIGZAG = 16
    SPRINTZ = 32


class Compression(_Coded):
    UNCOMPRESSED = 0
    SNAPPY = 1
    GZIP = 2
    LZO = 3
    LZ4 = 7

    @property
    def parquet(self) -> str:
        """Parquet's codec; LZO is kept as a name and stored uncompressed.

        LZ4 is the framed form: Spark's reader at times fails on dictionaries in the raw one.
        """
        return {"UNCOMPRESSED": "uncompressed", "SNAPPY": "snappy", "GZIP": "gzip", "LZO": "uncompressed", "LZ4": "lz4"}[self.name]


class Category(_Coded):
    TAG = 0
    FIELD = 1


class NodeType(_Coded):
    """Levels of a series index, kept for catalog output."""

    INTERNAL_DEVICE = 0
    LEAF_DEVICE = 1
    INTERNAL_MEASUREMENT = 2
    LEAF_MEASUREMENT = 3


_WHOLE = frozenset({Encoding.PLAIN, Encoding.TS_2DIFF, Encoding.GORILLA, Encoding.RLE, Encoding.ZIGZAG, Encoding.SPRINTZ})
_REAL = frozenset({Encoding.PLAIN, Encoding.TS_2DIFF, Encoding.GORILLA, Encoding.SPRINTZ})
#: Encodings that a type may have.
LEGAL = {
    DataType.BOOLEAN: frozenset({Encoding.PLAIN}), DataType.INT32: _WHOLE, DataType.INT64: _WHOLE, DataType.FLOAT: _REAL, DataType.DOUBLE: _REAL,
    DataType.TEXT: frozenset({Encoding.PLAIN, Encoding.DICTIONARY}), DataType.STRING: frozenset({Encoding.PLAIN, Encoding.DICTIONARY}),
}


def check_encoding(kind: DataType, encoding: Encoding) -> None:
    if encoding not in LEGAL[kind]:
        raise UnsupportedError(f"no {encoding.name} for values of type {kind.name}")


@dataclass
class Config:
    """Defaults of writers; the first block has a counterpart in Parquet's own settings."""

    page_points: int = 10_000
    page_bytes: int = 128 * 1024
    group_bytes: int = 128 * 1024 * 1024
    bloom_error: float = 0.05
    index_degree: int = 256
    time_encoding: Encoding = Encoding.TS_2DIFF
    compression: Compression = Compression.LZ4
    encodings: dict = field(default_factory=lambda: {
        DataType.BOOLEAN: Encoding.PLAIN, DataType.INT32: Encoding.TS_2DIFF, DataType.INT64: Encoding.TS_2DIFF, DataType.FLOAT: Encoding.GORILLA,
        DataType.DOUBLE: Encoding.GORILLA, DataType.TEXT: Encoding.PLAIN, DataType.STRING: Encoding.PLAIN,
    })

    def set_encoding(self, kind: DataType, encoding: Encoding) -> None:
        check_encoding(kind, encoding)
        self.encodings[kind] = encoding

    def parquet_options(self) -> dict[str, str]:
        return {
            "compression": self.compression.parquet, "parquet.block.size": str(self.group_bytes), "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_points), "parquet.bloom.filter.enabled#device_path": "true", "parquet.bloom.filter.fpp#device_path": str(self.bloom_error),
        }


# Device paths

def parse_path(path: str) -> list[str]:
    """Segments of a dotted path. Backticks quote dots; empty segments stay; an empty path has none."""
    if not path:
        return []
    stretches = path.split("`")  # every second one is quoted
    if len(stretches) % 2 == 0:
        raise InvalidArgError(f"path {path!r} has an odd number of backticks")
    out = [""]
    for k, stretch in enumerate(stretches):
        first, *rest = [stretch] if k % 2 else stretch.split(".")
        out[-1] += first
        out += rest
    return out


def format_path(segments: list[str]) -> str:
    """The display form: segments that hold a dot are quoted."""
    return ".".join(f"`{s}`" if "." in s else s for s in segments)


# Schemas

@dataclass(frozen=True)
class Measurement:
    name: str
    type: DataType
    encoding: Encoding = Encoding.PLAIN
    compression: Compression = Compression.LZ4

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark, True, {"encoding": self.encoding.name, "compression": self.compression.name})


class MeasurementGroup:
    """A device's measurements by name; a later definition of a name replaces the earlier."""

    def __init__(self, aligned: bool = False):
        self.aligned = aligned
        self._by_name: dict[str, Measurement] = {}

    def add(self, m: Measurement) -> None:
        self._by_name[m.name] = m

    def get(self, name: str) -> Measurement | None:
        return self._by_name.get(name)

    def __iter__(self):
        return iter(sorted(self._by_name.values(), key=lambda m: m.name))

    def __len__(self):
        return len(self._by_name)


class Registry:
    """Measurements by device; registering a known name again does nothing."""

    def __init__(self):
        self._devices: dict[tuple[str, ...], dict[str, Measurement]] = {}

    def register(self, device: str, m: Measurement) -> None:
        check_encoding(m.type, m.encoding)
        self._devices.setdefault(tuple(parse_path(device)), {}).setdefault(m.name, m)

    def of(self, device: str) -> dict[str, Measurement]:
        return self._devices.get(tuple(parse_path(device)), {})

    def need(self, device: str, name: str) -> Measurement:
        found = self.of(device).get(name)
        if found is None:
            raise NotFoundError(f"measurement {name} of {device} is not registered")
        return found


@dataclass(frozen=True)
class Column:
    name: str
    type: DataType
    category: Category = Category.FIELD


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]

    def find(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def tags(self) -> list[Column]:
        return [c for c in self.columns if c.category is Category.TAG]

    def fields(self) -> list[Column]:
        return [c for c in self.columns if c.category is Category.FIELD]

    def struct(self) -> T.StructType:
        columns = [T.StructField(c.name, c.type.spark, True, {"category": c.category.name}) for c in self.columns]
        return T.StructType([T.StructField("time", T.LongType(), False), *columns])

    @classmethod
    def from_struct(cls, name: str, struct: T.StructType) -> "TableSchema":
        columns = (Column(f.name, DataType.from_spark(f.dataType), Category[f.metadata.get("category", "FIELD")]) for f in struct if f.name != "time")
        return cls(name, tuple(columns))


# Rows and batches that writers take

@dataclass(frozen=True)
class Point:
    name: str
    type: DataType | None
    value: object = None


class Record:
    """One device's values at one time."""

    def __init__(self, device: str, time: int):
        self.device, self.time, self.points = device, time, []

    def add(self, name: str, kind: DataType, value) -> "Record":
        self.points.append(Point(name, kind, value))
        return self

    def add_null(self, name: str) -> "Record":
        self.points.append(Point(name, None))
        return self

    def find(self, name: str) -> Point | None:
        return next((p for p in self.points if p.name == name), None)

    def __len__(self):
        return len(self.points)

    def check_types(self, expected: dict[str, DataType]) -> None:
        """Known names must have the expected type; nulls and unknown names pass."""
        for p in self.points:
            if p.type is not None and p.name in expected and p.type is not expected[p.name]:
                raise TypeMismatchError(expected[p.name], p.type)


class NullMask:
    """Set bits mark nulls, the lowest bit of a byte first."""

    def __init__(self, size: int, data: bytes | None = None):
        self.size = size
        self._bits = np.zeros(-(-size // 8) * 8, dtype=np.uint8) if data is None else np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")

    def _at(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise InvalidArgError(f"bit {i} of {self.size}")
        return i

    def get(self, i: int) -> bool:
        return bool(self._bits[self._at(i)])

    def set(self, i: int) -> None:
        self._bits[self._at(i)] = 1

    def clear(self, i: int) -> None:
        self._bits[self._at(i)] = 0

    def clear_all(self) -> None:
        self._bits[:] = 0

    def count(self) -> int:
        return int(self._bits.sum())

    def none_set(self) -> bool:
        return not self._bits.any()

    def to_bytes(self) -> bytes:
        return np.packbits(self._bits, bitorder="little").tobytes()


_PYTHON = {DataType.BOOLEAN: bool, DataType.INT32: int, DataType.INT64: int, DataType.FLOAT: float, DataType.DOUBLE: float, DataType.TEXT: bytes, DataType.STRING: str}


class Tablet:
    """Rows of one device, column by column. Cells that are never set are null."""

    def __init__(self, device: str, columns: list[Measurement], capacity: int = 1024):
        self.device, self.columns, self.capacity = device, list(columns), capacity
        self.times: list[int] = []
        self._cells: list[dict[int, object]] = [{} for _ in columns]

    def add_time(self, row: int, time: int) -> None:
        """Rows come in sequence, each once."""
        if row != len(self.times) or row >= self.capacity:
            raise InvalidArgError(f"row {row} after {len(self.times)} rows, capacity {self.capacity}")
        self.times.append(time)

    def set(self, row: int, column: int, value) -> None:
        if not 0 <= column < len(self.columns) or not 0 <= row < self.capacity:
            raise InvalidArgError(f"cell ({row}, {column})")
        kind = self.columns[column].type
        if kind is DataType.TEXT and isinstance(value, str):
            value = value.encode()
        if type(value) is not _PYTHON[kind]:
            raise TypeMismatchError(kind, next((k for k, t in _PYTHON.items() if t is type(value)), kind))
        if kind in (DataType.INT32, DataType.INT64) and not -(1 << (31 if kind is DataType.INT32 else 63)) <= value < 1 << (31 if kind is DataType.INT32 else 63):
            raise TypeMismatchError(kind, DataType.INT64)
        self._cells[column][row] = value

    def set_null(self, row: int, column: int) -> None:
        self._cells[column].pop(row, None)

    def is_null(self, row: int, column: int) -> bool:
        return row not in self._cells[column]

    def reset(self) -> None:
        self.times.clear()
        for c in self._cells:
            c.clear()

    def __len__(self):
        return len(self.times)

    def rows(self) -> list[tuple]:
        return [(t, *(c.get(i) for c in self._cells)) for i, t in enumerate(self.times)]
