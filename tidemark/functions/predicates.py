"""The filter algebra: time and value predicates with AND, OR and NOT, in two-valued logic.

Each filter gives three conditions: on rows; on rows by time alone, which holds
wherever the row condition can hold and may go below a merge; and on statistics
(count, start_time, end_time, min, max), which is false only where no row of
the stretch can pass.

A null or NaN value satisfies no value predicate, and NOT turns false into
true. Positive predicates stay bare conjuncts, which Spark pushes into the scan;
only a negated value predicate is wrapped in ``coalesce``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import DataType, InvalidArgError, TypeMismatchError


def _long(micros: int) -> Column:
    return F.lit(micros).cast("long")


class Filter:
    """A predicate over (time, value). Subclasses may override any of the conditions."""

    def row(self, time: Column, value: Column, kind: DataType | None) -> Column:
        raise NotImplementedError

    def time_only(self, time: Column, literal=_long) -> Column | None:
        """A condition on the time that every passing row meets, or None.

        ``literal`` makes a bound comparable with ``time``, for times that are
        stored as something other than whole numbers.
        """
        return None

    def statistic(self, kind: DataType | None, names: dict[str, str] | None = None) -> Column:
        return F.lit(True)

    def needs_value(self) -> bool:
        return False

    def total(self, time: Column, value: Column, kind: DataType | None) -> Column:
        """The row condition with false for unknown."""
        return F.coalesce(self.row(time, value, kind), F.lit(False)) if self.needs_value() else self.row(time, value, kind)

    def __and__(self, other: "Filter") -> "Filter":
        return And(self, other)

    def __or__(self, other: "Filter") -> "Filter":
        return Or(self, other)

    def __invert__(self) -> "Filter":
        return Not(self)


_STAT = {"count": "count", "start": "start_time", "end": "end_time", "min": "min", "max": "max"}


def _stat(names, key: str) -> Column:
    return F.col((names or {}).get(key, _STAT[key]))


@dataclass(frozen=True)
class Time(Filter):
    """time <op> bound, for >, >=, <, <= and =."""

    op: str
    bound: int

    def row(self, time, value=None, kind=None):
        return self.time_only(time)

    def time_only(self, time, literal=_long):
        b = literal(self.bound)
        return {">": time > b, ">=": time >= b, "<": time < b, "<=": time <= b, "=": time == b}[self.op]

    def statistic(self, kind=None, names=None):
        start, end, b = _stat(names, "start"), _stat(names, "end"), F.lit(self.bound).cast("long")
        holds = {">": end > b, ">=": end >= b, "<": start < b, "<=": start <= b, "=": (start <= b) & (end >= b)}[self.op]
        return (_stat(names, "count") > 0) & holds


@dataclass(frozen=True)
class TimeBetween(Filter):
    low: int
    high: int
    inclusive: bool = True

    def row(self, time, value=None, kind=None):
        return self.time_only(time)

    def time_only(self, time, literal=_long):
        low, high = literal(self.low), literal(self.high)
        return (time >= low) & (time <= high) if self.inclusive else (time > low) & (time < high)

    def statistic(self, kind=None, names=None):
        start, end = _stat(names, "start"), _stat(names, "end")
        low, high = F.lit(self.low).cast("long"), F.lit(self.high).cast("long")
        overlap = (end >= low) & (start <= high) if self.inclusive else (end > low) & (start < high)
        return (_stat(names, "count") > 0) & overlap


_LITERALS = {
    bool: {DataType.BOOLEAN}, int: {DataType.INT32, DataType.INT64}, float: {DataType.FLOAT, DataType.DOUBLE}, str: {DataType.STRING}, bytes: {DataType.TEXT},
}


@dataclass(frozen=True)
class Value(Filter):
    """value <op> bound, for =, > and <. The bound's type must be the series' type."""

    op: str
    bound: object
    type: DataType | None = None

    def needs_value(self):
        return True

    def literal_type(self, kind: DataType | None) -> DataType:
        allowed = _LITERALS.get(type(self.bound))
        if allowed is None:
            raise InvalidArgError(f"no series type for a bound of {type(self.bound).__name__}")
        mine = self.type or (kind if kind in allowed else max(allowed))
        if mine not in allowed:
            raise TypeMismatchError(mine, max(allowed))
        return mine

    def row(self, time, value, kind):
        mine = self.literal_type(kind)
        if kind is not None and kind is not mine:
            raise TypeMismatchError(kind, mine)
        if isinstance(self.bound, float) and math.isnan(self.bound):
            return F.lit(False)
        b = F.lit(self.bound).cast(mine.spark)
        holds = {"=": value == b, ">": value > b, "<": value < b}[self.op]
        return holds & ~F.isnan(value) if mine.floating else holds

    def statistic(self, kind=None, names=None):
        some = _stat(names, "count") > 0
        if kind is not None and not kind.ordered:
            return some
        self.literal_type(kind)
        if isinstance(self.bound, float) and math.isnan(self.bound):
            return F.lit(False)
        low, high, b = _stat(names, "min"), _stat(names, "max"), F.lit(self.bound)
        return some & F.coalesce({"=": (low <= b) & (high >= b), ">": high > b, "<": low < b}[self.op], F.lit(False))


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter

    def needs_value(self):
        return self.left.needs_value() or self.right.needs_value()

    def row(self, time, value, kind):
        return self.left.row(time, value, kind) & self.right.row(time, value, kind)

    def time_only(self, time, literal=_long):
        sides = [c for c in (self.left.time_only(time, literal), self.right.time_only(time, literal)) if c is not None]
        return sides[0] & sides[1] if len(sides) == 2 else sides[0] if sides else None

    def statistic(self, kind=None, names=None):
        return self.left.statistic(kind, names) & self.right.statistic(kind, names)


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter

    def needs_value(self):
        return self.left.needs_value() or self.right.needs_value()

    def row(self, time, value, kind):
        return self.left.row(time, value, kind) | self.right.row(time, value, kind)

    def time_only(self, time, literal=_long):
        left, right = self.left.time_only(time, literal), self.right.time_only(time, literal)
        return None if left is None or right is None else left | right

    def statistic(self, kind=None, names=None):
        return self.left.statistic(kind, names) | self.right.statistic(kind, names)


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter

    def needs_value(self):
        return self.inner.needs_value()

    def row(self, time, value, kind):
        return ~self.inner.total(time, value, kind)

    def time_only(self, time, literal=_long):
        """Only a filter of times alone can be turned round: what it leaves out is then what passes."""
        return None if self.inner.needs_value() else ~self.inner.time_only(time, literal)


@dataclass(frozen=True)
class Custom(Filter):
    """A filter of the caller's own: a function from the time and value columns to a condition, or a pandas UDF of both."""

    condition: object

    def needs_value(self):
        return True

    def row(self, time, value, kind):
        return self.condition(time, value)


def time_gt(b):
    return Time(">", b)


def time_gteq(b):
    return Time(">=", b)


def time_lt(b):
    return Time("<", b)


def time_lteq(b):
    return Time("<=", b)


def time_eq(b):
    return Time("=", b)


def time_between(low, high, inclusive=True):
    return TimeBetween(low, high, inclusive)


def value_eq(b, type=None):
    return Value("=", b, type)


def value_gt(b, type=None):
    return Value(">", b, type)


def value_lt(b, type=None):
    return Value("<", b, type)
