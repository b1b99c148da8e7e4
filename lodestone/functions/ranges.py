"""Ranges of whole numbers as dyadic cells, so that ranges meet by equality instead of number by number.

A cell (level, index) is the range from index * 2**level on, 2**level long. A range is a few cells, two a level at most; a
range overlaps another if and only if a cell of one is a cell of the other or lies inside one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 14  # the largest cells hold 16,384 numbers; longer ranges have several of them


def cells(start: Column, end: Column) -> Column:
    """Array of (level, index) of the cells that make up start to end, both included; empty if end is before start. Numbers from 0 on."""

    def of_level(k: Column) -> Column:
        low, high = F.call_function("shiftright", start.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", end.cast("long") + 1, k)
        cell = lambda i: F.struct(k.cast("int").alias("level"), i.alias("index"))
        edges = F.filter(F.array(F.when(low % 2 == 1, cell(low)), F.when(high % 2 == 1, cell(high - 1))), lambda c: c.isNotNull())
        whole = F.transform(F.sequence(low, high - 1), cell)
        none = F.array().cast("array<struct<level:int,index:bigint>>")
        return F.when(low >= high, none).when(k == TOP, whole).otherwise(edges)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP)), of_level))


def above(found: Column) -> Column:
    """The cells that the given ones lie inside, without these, each once."""
    up = lambda c: F.transform(F.filter(F.sequence(F.lit(1), F.lit(TOP)), lambda k: k > c["level"]), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", c["index"], k - c["level"]).alias("index")))
    return F.array_distinct(F.flatten(F.transform(found, up)))


BITS = 7  # a bucket holds 128 numbers


def edges(start: Column, end: Column) -> Column:
    """Array of (bucket, low, high): what start to end, both included, take of the first and the last bucket that they touch."""
    low, high = start.cast("long"), end.cast("long")
    at = lambda x: F.call_function("shiftright", x, F.lit(BITS))
    inner, last = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"), F.lit((1 << BITS) - 1)
    edge = lambda bucket, a, b: F.struct(bucket.alias("bucket"), a.alias("low"), b.alias("high"))
    return F.when(at(low) == at(high), F.array(edge(at(low), inner(low), inner(high)))).otherwise(F.array(edge(at(low), inner(low), last), edge(at(high), F.lit(0), inner(high))))


def between(start: Column, end: Column) -> Column:
    """The cells of the buckets that lie between the first and the last of a range."""
    at = lambda x: F.call_function("shiftright", x.cast("long"), F.lit(BITS))
    return cells(at(start) + 1, at(end) - 1)
