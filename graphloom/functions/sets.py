"""Sets of ids: as columns of arrays, and as frames with an ``id`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added(s: Column, x: Column) -> Column:
    return F.array_union(s, F.array(x))


def merged(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def removed(s: Column, x: Column) -> Column:
    return F.array_except(s, F.array(x))


def has(s: Column, x: Column) -> Column:
    return F.array_contains(s, x)


def meets(a: Column, b: Column) -> Column:
    """Whether two sets have an element in common."""
    return F.arrays_overlap(a, b)


def size(s: Column) -> Column:
    return F.size(s)


def top(s: Column) -> Column:
    """Some element, the first; -1 of an empty set."""
    return F.coalesce(F.get(s, F.lit(0)), F.lit(-1))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))
