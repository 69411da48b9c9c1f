"""Greedy folds over the sizes of a group's items, in linear time: only arrays of numbers get to Python, and what they decide comes back as numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.ArrayType(T.IntegerType())
#: The same for Arrow: numbers, and lists of them.
NUMBERS, LISTS = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
#: Items of a batch's rows that are Python objects at a time, but for a row that has more.
ITEMS = 1 << 16


def by_rows(fold: Callable[..., list | None], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What a fold makes of each row's arrays, null where the first is: rows are taken a stretch of bounded items at a time, so that of a batch of long rows only numbers are held."""
    sizes = columns[0].value_lengths().fill_null(0).to_pylist()
    out, first, items = [], 0, 0
    for k, n in enumerate([*sizes, ITEMS]):
        if k > first and (items + n > ITEMS or k == len(sizes)):
            rows = zip(*(c.slice(first, k - first).to_pylist() for c in columns), strict=True)
            out.append(pa.array([None if row[0] is None else fold(*row) for row in rows], kind))
            first, items = k, 0
        items += n
    return pa.concat_arrays(out) if out else pa.array([], kind)


def filled_runs(halves: Iterable[int], least: int) -> list[list[int]]:
    """Runs (first, last): one takes in items until its tokens reach the least; the last may stay below."""
    out: list[list[int]] = []
    half = 0
    for k, own in enumerate(halves):
        if out and half // 2 + 1 < least:
            out[-1][1] = k
            half += own
        else:
            out.append([k, k])
            half = own
    return out


def fitting_runs(halves: Iterable[int], most: int) -> list[list[int]]:
    """Runs (first, last): one takes in items as long as its tokens stay within the most; an item that is larger alone is a run."""
    out: list[list[int]] = []
    half = 0
    for k, own in enumerate(halves):
        if out and (half + own) // 2 + 1 <= most:
            out[-1][1] = k
            half += own
        else:
            out.append([k, k])
            half = own
    return out


def bin_numbers(sizes: Iterable[int], limit: int) -> list[int]:
    """A new bin when the next item would overflow one that isn't empty."""
    out, used, number = [], 0, 0
    for size in sizes:
        if used > 0 and used + size > limit:
            used, number = 0, number + 1
        used += size
        out.append(number)
    return out


def group_numbers(sizes: Iterable[int], least: int) -> list[int]:
    """A group below the least size takes in the next item."""
    out, used, number = [], 0, -1
    for size in sizes:
        if number < 0 or used >= least:
            used, number = 0, number + 1
        used += size
        out.append(number)
    return out


def choices(sizes: Iterable[int], originals: Iterable[int], promoted: Iterable[bool], limit: int) -> list[int]:
    """1 for an item that fits into what is left, 2 for a promoted one of which only the original fits, 0 for one that is skipped."""
    out, left = [], limit
    for size, original, whole in zip(sizes, originals, promoted, strict=True):
        choice = 1 if size <= left else 2 if whole and original <= left else 0
        left -= (0, size, original)[choice]
        out.append(choice)
    return out


def _apart(fold: Callable[..., Column]) -> Callable[..., Column]:
    """Declared as not deterministic (it is), so that Spark never moves the call into a lambda of a later projection, where it couldn't run."""
    return fold.asNondeterministic()


def runs_until(halves: Column, least: int) -> Column:
    @F.arrow_udf(T.ArrayType(RUN))
    def fold(x: pa.Array) -> pa.Array:
        return by_rows(lambda a: filled_runs(a, least), LISTS, x)

    return _apart(fold)(halves)


def runs_within(halves: Column, most: int) -> Column:
    """Of an array of arrays: each one's runs."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(RUN)))
    def fold(x: pa.Array) -> pa.Array:
        return by_rows(lambda a: [fitting_runs(own, most) for own in a], pa.list_(LISTS), x)

    return _apart(fold)(halves)


def bins(sizes: Column, limit: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def fold(x: pa.Array) -> pa.Array:
        return by_rows(lambda a: bin_numbers(a, limit), NUMBERS, x)

    return _apart(fold)(sizes)


def groups(sizes: Column, least: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def fold(x: pa.Array) -> pa.Array:
        return by_rows(lambda a: group_numbers(a, least), NUMBERS, x)

    return _apart(fold)(sizes)


def chosen(sizes: Column, originals: Column, promoted: Column, limit: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def fold(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return by_rows(lambda a, b, c: choices(a, b, c, limit), NUMBERS, x, y, z)

    return _apart(fold)(sizes, originals, promoted)


def _in_order(start: Callable[[int], tuple[int, int]], step: Callable[[int, int, int], tuple[int, int]], places: Column, sizes: Column) -> Column:
    """The number of each row of a task's groups, whose rows come in order: places: a row's place in its group from 1; start, step: the state and the number that a size begins with, or leads to. Nothing of a group is held."""

    @F.arrow_udf(T.IntegerType())
    def fold(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        state = number = 0
        for batch in batches:
            out = []
            for place, size in zip(*(x.to_pylist() for x in batch), strict=True):
                state, number = start(size) if place == 1 else step(state, number, size)
                out.append(number)
            yield pa.array(out, pa.int32())

    return _apart(fold)(places, sizes)


def run_rows(places: Column, halves: Column, least: int) -> Column:
    """filled_runs, row by row: the number of a row's run."""
    return _in_order(lambda own: (own, 0), lambda half, number, own: (half + own, number) if half // 2 + 1 < least else (own, number + 1), places, halves)


def bin_rows(places: Column, sizes: Column, limit: int) -> Column:
    """bin_numbers, row by row."""
    return _in_order(lambda size: (size, 0), lambda used, number, size: (size, number + 1) if used > 0 and used + size > limit else (used + size, number), places, sizes)


def group_rows(places: Column, sizes: Column, least: int) -> Column:
    """group_numbers, row by row."""
    return _in_order(lambda size: (size, 0), lambda used, number, size: (size, number + 1) if used >= least else (used + size, number), places, sizes)
