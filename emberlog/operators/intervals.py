"""Joins of spans of time with points in time that share keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the narrowest buckets.
BASE = 600


def level_of(start: Column, end: Column, base: int) -> Column:
    """The least k with base * 2^k seconds more than end - start: a span lies in two buckets of that width at most."""
    wide = F.floor((end - start) / base)
    return F.when(wide > 0, F.length(F.bin(wide))).otherwise(0)


def width_of(level: Column, base: int) -> Column:
    return F.call_function("shiftleft", F.lit(base).cast("long"), level)


def met(spans: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, at: Column, base: int = BASE) -> DataFrame:
    """Pairs of a span and a point with equal keys that lie in one bucket of time, each pair once: what interval_join() tests.

    A span goes to the buckets of its own level, two at most however long it is; a point to one bucket of each level that any span
    has. So the rows that meet are those near in time, and grow with the log, not with its square; and a key that holds much of
    both sides is many buckets. Levels are a few small numbers, which are asked for first.
    """
    own = spans.withColumn("_level", level_of(start, end, base))
    levels = own.filter(end >= start).select(F.coalesce(F.array_sort(F.collect_set("_level")), F.array()).cast("array<int>")).first()[0]
    number = lambda x: F.floor(x / width_of(F.col("_level"), base))
    spread = own.filter(end >= start).withColumn("_bucket", F.explode(F.sequence(number(start), number(end))))
    each = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", number(at))
    return spread.join(each, [*keys, "_level", "_bucket"]).drop("_level", "_bucket")


def interval_join(spans: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, at: Column, base: int = BASE) -> DataFrame:
    """Spans joined with the points of equal keys that lie in [start, end]; start and end are of the span, `at` is of the point.
    Spans without a start or end, or with an end before the start, and points without a time have no partner."""
    return met(spans, points, keys, start, end, at, base).filter((at >= start) & (at <= end))
