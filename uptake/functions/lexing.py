"""Positions, brackets and statements of lexed source texts.

All helpers are per-row Column expressions: one source file is one row, and
nothing here shuffles.  Offsets are 0-based bytes; lines and columns are 1-based
with byte columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import byte_len, let, running_ends


def with_bytes(text: Column, body) -> Column:
    """Hand the bytes of a text to ``body``, for many slices: a column's bytes are copied whenever they are asked for."""
    return let(text.cast("binary"), body)


def byte_slice(text: Column, start: Column, length: Column) -> Column:
    return F.substr(text.cast("binary"), (start + 1).cast("int"), length.cast("int")).cast("string")


def line_ends(text: Column) -> Column:
    """Offset behind each line break, ascending."""
    return running_ends(F.transform(F.split(text, "\n"), lambda p: (byte_len(p) + 1).cast("bigint")))


#: Powers of two, descending: the steps of a binary search.
_STEPS = [1 << k for k in range(30, -1, -1)]


def count_up_to(sorted_values: Column, x: Column, of=lambda v: v) -> Column:
    """How many of the ascending values (``of`` an element) are <= x, by binary search."""
    def step(acc, bit):
        probe = acc + bit
        return F.when(
            (probe <= F.size(sorted_values)) & (of(F.try_element_at(sorted_values, probe)) <= x), probe).otherwise(acc)

    top = F.floor(F.log2(F.greatest(F.size(sorted_values), F.lit(1)))).cast("int")
    steps = F.slice(F.array(*[F.lit(s) for s in _STEPS]), len(_STEPS) - top, top + 1)
    return F.aggregate(steps, F.lit(0), step)


def place(ends: Column, offset: Column) -> Column:
    """(line, col) of an offset, given :func:`line_ends` of the text."""
    return let(
        count_up_to(ends, offset),
        lambda n: F.struct(
            (n + 1).cast("bigint").alias("line"),
            (offset - F.when(n > 0, F.try_element_at(ends, n)).otherwise(F.lit(0)) + 1).cast("bigint").alias("col")))


def close_of(pairs: Column, open_at: Column) -> Column:
    """Offset of the bracket that closes the one at ``open_at``, else null.

    Pairs are sorted by opener, so the partner is found by binary search.
    """
    def found(n):
        pair = F.when(n > 0, F.try_element_at(pairs, n))
        return F.when(pair["open"] == open_at, pair["close"])

    return let(count_up_to(pairs, open_at, lambda p: p["open"]), found)


def element_at(sorted_values: Column, x: Column, of) -> Column:
    """The element whose ``of`` is x, else null."""
    def found(n):
        one = F.when(n > 0, F.try_element_at(sorted_values, n))
        return F.when(of(one) == x, one)

    return let(count_up_to(sorted_values, x, of), found)


def depth_at(pos: Column) -> Column:
    """How many brackets and elements are open behind the byte at ``pos``."""
    return (count_up_to(F.col("opened"), pos) - count_up_to(F.col("closed"), pos)).cast("bigint")


def _level(depth: Column, at: Column) -> Column:
    return F.struct(depth.cast("bigint").alias("depth"), at.cast("bigint").alias("at"))


def statement_end(pos: Column) -> Column:
    """Where the statement that ``pos`` stands in ends: a line break, a semicolon or the end of its group; else null.

    Stops are sorted by depth, so those inside brackets that open later are not met.
    """
    def first(depth):
        stop = F.try_element_at(F.col("stops"), count_up_to(F.col("stops"), _level(depth, pos)) + 1)
        return F.when(stop["depth"] == depth, stop["at"])

    return let(depth_at(pos), first)


def arguments(open_at: Column, close_at: Column, text: Column) -> Column:
    """What stands between the commas of a bracket group itself, as texts."""
    def between(depth):
        commas = F.col("commas")
        low, high = (count_up_to(commas, _level(depth, x)) for x in (open_at, close_at))
        inner = F.transform(F.slice(commas, low + 1, F.greatest(high - low, F.lit(0))), lambda c: c["at"])
        return F.concat(F.array(open_at), inner, F.array(close_at))

    def cut(cuts):
        return F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda a, i: byte_slice(text, a + 1, F.element_at(cuts, i + 2) - a - 1))

    return F.when(close_at.isNotNull(), let(let(depth_at(open_at), between), cut))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection may be copied into every later use; a one-row generator
    may not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
