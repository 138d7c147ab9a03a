"""Exact quantiles of tables of any size: values are found by their places in one order of different values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Ordered
from .tables import small


def values_at(rows: DataFrame, value: str, group: list[str], places: dict[str, Column]) -> DataFrame:
    """(group, n, names): for each group the number of its values and those at the places wanted: 0, 1, ... in rising order, as
    expressions of n. Nulls aren't counted; null is a group too; an empty table has no groups, or, without any, n = 0.

    Values are counted before they are shuffled; the different ones stand in one stored order by group and value, in which running
    counts tell which places each covers. Then each part of the order gives what it has of the places wanted.
    """
    names = [f"__g{i}" for i in range(len(group))]
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*(F.col(g).alias(a) for g, a in zip(group, names, strict=True)), F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    run = Ordered(counts, *(F.col(c).asc_nulls_first() for c in (*names, "__v"))).running(__to=(F.sum, "__c", "upto"))
    totals = run.groupBy(*names).agg(F.sum("__c").alias("n"), (F.max("__to") - F.sum("__c")).alias("__base"))
    if group:
        other = small(totals.toDF(*(f"__o{i}" for i in range(len(group))), "n", "__base"))
        same = [F.col(a).eqNullSafe(F.col(f"__o{i}")) for i, a in enumerate(names)]
        both = run.join(other, same)
    else:
        both = run.crossJoin(F.broadcast(totals))  # one row
    place = F.col("__to") - F.col("__base")
    own = {k: F.max(F.when((p >= place - F.col("__c")) & (p < place), F.col("__v"))).alias(k) for k, p in places.items()}
    out = both.groupBy(*names).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *own.values())
    return out.select(*(F.col(a).alias(g) for a, g in zip(names, group, strict=True)), "n", *own)


def linear(rows: DataFrame, value: str, group: list[str], fractions: dict[str, float]) -> DataFrame:
    """(group, n, names): quantiles between the two values nearest to place (n - 1) * p, in proportion."""
    at = {k: (F.col("n") - 1) * F.lit(float(p)) for k, p in fractions.items()}
    found = values_at(rows, value, group, {f"__{end}_{k}": f(p) for k, p in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))})

    def between(k: str) -> Column:
        lo, hi, share = F.col(f"__lo_{k}").cast("double"), F.col(f"__hi_{k}").cast("double"), at[k] - F.floor(at[k])
        return F.when(lo == hi, lo).otherwise(lo * (1 - share) + hi * share).alias(k)

    return found.select(*group, "n", *map(between, fractions))


def nearest(rows: DataFrame, value: str, group: list[str], fractions: dict[str, float]) -> DataFrame:
    """(group, n, names): the values at place round((n - 1) * p), half to even."""
    return values_at(rows, value, group, {k: F.bround((F.col("n") - 1) * F.lit(float(p))) for k, p in fractions.items()})


def joined(stats: DataFrame, quantiles: DataFrame, group: list[str]) -> DataFrame:
    """Aggregates and quantiles of the same groups, beside one another."""
    q = quantiles.drop("n")
    if not group:
        return stats.crossJoin(F.broadcast(q))  # a row each
    other = q.withColumnsRenamed({g: f"__{g}" for g in group})
    return stats.join(other, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], "left").drop(*(f"__{g}" for g in group))


def names_of(fractions: tuple[float, ...], head: str = "p") -> dict[str, float]:
    return {f"{head}{math.floor(100 * p + 0.5):02d}" if p not in (0.0, 1.0) else f"{head}{int(100 * p)}": p for p in fractions}
