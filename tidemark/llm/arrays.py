"""Array and text expressions whose work stays near linear in the array's or text's length.

Each takes the name of a column and gives an expression that uses it twice or
more: Spark puts what is used once into the lambda that uses it. Arrays are taken in stretches: a fold that grows an array copies
it at each step, so it may only grow a short one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a stretch; a stretch is folded in its square, the stretches' totals in theirs.
STRETCH = 256
#: Code points of a chunk of text, as a power of two.
CHUNK_BITS = 12


def _fold(values: Column, first: int, combine: Callable[[Column, Column], Column], shift: bool = False) -> Column:
    zero = F.struct(F.lit(first).alias("t"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a, x):
        t = combine(a["t"], x)
        return F.struct(t.alias("t"), F.concat(a["out"], F.array(a["t"] if shift else t)).alias("out"))

    return F.aggregate(values, zero, step, lambda a: a["out"])


def running(name: str, first: int, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative function over an array of int; ``first`` is its neutral value."""
    values = F.col(name)
    many = F.greatest(F.ceil(F.size(values) / STRETCH).cast("int") - 1, F.lit(0))
    stretches = F.transform(F.sequence(F.lit(0), many), lambda k: _fold(F.slice(values, k * STRETCH + 1, F.lit(STRETCH)), first, combine))
    before = _fold(F.transform(stretches, lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(first))), first, combine, shift=True)
    return F.flatten(F.zip_with(stretches, before, lambda s, b: F.transform(s, lambda x: combine(b, x))))


def running_sum(name: str) -> Column:
    return running(name, 0, lambda a, b: a + b)


def running_max(name: str) -> Column:
    """For numbers from 0 on."""
    return running(name, 0, F.greatest)


def chunks(text: Column) -> Column:
    """A text in chunks of so many code points, for ``piece``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}"), F.lit(0))


def piece(name: str, start: Column, end: Column) -> Column:
    """The stretch of a text from start to end (exclusive), from the column of its chunks."""
    size = 1 << CHUNK_BITS

    def part(k):
        at = F.greatest(start - k * size, F.lit(0))
        return F.substring(F.get(name, k), at + 1, F.least(end - k * size, F.lit(size)) - at)

    numbers = F.sequence(F.shiftright(start, CHUNK_BITS), F.shiftright(end - 1, CHUNK_BITS))
    return F.when(start < end, F.array_join(F.transform(numbers, part), "")).otherwise("")

