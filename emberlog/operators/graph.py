"""Connected components of small tables of links, and orders of large tables: ranks, running totals, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved, small

#: Rows of one stretch of ranks, see beside().
STRETCH = 1 << 16


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node reached. Labels spread and jump each round; each round is a table in
    the shared folder."""
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        sent = edges.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "component")
        least = sent.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        ahead = least.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = saved(least.join(ahead, "component").select("node", F.least("component", "next").alias("component")), "labels")
        if new.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").isEmpty():
            return new
        labels = new


def rows_of(frame: str, partition: list[str], order: list, outer: bool = False):
    """The rows "before" a row, "upto" it, "after" it or "from" it on; outer: of the groups around, itself never included. What
    comes later is what comes before in the opposite order: Spark goes through a frame that grows once, but anew for each row of
    one that shrinks."""
    back = frame in ("after", "from")
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*partition).orderBy(*(c.desc() if back else c.asc() for c in by))
    return w.rowsBetween(Window.unboundedPreceding, 0 if frame in ("upto", "from") and not outer else -1)


class Ordered:
    """A table in a total order: stored once by a range sort, each row with the number of its part and its place there.

    Everything that needs the order (ranks, running values) reads that one table, so that rows and the sums of the parts before
    them can't come from different sorts. Parts are as many as the sort had partitions; only their totals are put in one row
    of order.
    """

    def __init__(self, rows: DataFrame, *order: Column):
        at = F.monotonically_increasing_id()
        self.names = rows.columns
        self.rows = saved(rows.orderBy(*order).withColumn("__at", at), "ordered").withColumn("__part", F.shiftright("__at", 33))

    def ranked(self, to: str = "rank") -> DataFrame:
        """Adds 1, 2, ... in order."""
        n = self.rows.groupBy("__part").agg(F.count("*").alias("__c"))
        before = n.select("__part", F.coalesce(F.sum("__c").over(rows_of("before", [], ["__part"])), F.lit(0)).alias("__b"))
        place = F.col("__at").bitwiseAND((1 << 33) - 1) + 1
        return self.rows.join(F.broadcast(before), "__part").select(*self._names(), (place + F.col("__b")).alias(to))

    def running(self, **values) -> DataFrame:
        """Adds, for each name, what (aggregate, argument, frame) tells: F.sum, F.max or F.min over all rows before this one
        ("before"), with it ("upto"), after it ("after") or from it on ("from"). An aggregate of no rows is null."""
        totals = self.rows.groupBy("__part").agg(*(kind(arg).alias(k) for k, (kind, arg, _) in values.items()))
        others = totals.select("__part", *(kind(k).over(rows_of(f, [], ["__part"], outer=True)).alias(f"__o_{k}") for k, (kind, _, f) in values.items()))
        rows = self.rows.select("*", *(kind(arg).over(rows_of(f, ["__part"], ["__at"])).alias(f"__i_{k}") for k, (kind, arg, f) in values.items()))
        both = rows.join(F.broadcast(others), "__part")
        return both.select(*self._names(), *(joined(v[0], F.col(f"__i_{k}"), F.col(f"__o_{k}")).alias(k) for k, v in values.items()))

    def _names(self) -> list[Column]:
        return [F.col(f"`{n}`") for n in self.names]


def joined(kind, a: Column, b: Column) -> Column:
    """An aggregate of two parts' aggregates; either may be null, for no rows."""
    if kind is F.sum:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return {F.max: F.greatest, F.min: F.least}[kind](a, b)


def global_rank(rows: DataFrame, *order: Column, to: str = "rank") -> DataFrame:
    """Adds 1, 2, ... in the given total order, by a stored range sort; no single task sorts all."""
    return Ordered(rows, *order).ranked(to)


def rank_within(rows: DataFrame, group: Column, *order: Column, to: str) -> DataFrame:
    """Adds 1, 2, ... inside each group: places in one stored order of all groups, less the place before the group's first. A group
    that has most of the rows is as many parts as its rows are."""
    own = global_rank(rows.withColumn("__group", group), F.col("__group"), *order, to="__at")
    first = small(own.groupBy("__group").agg((F.min("__at") - 1).alias("__before")).withColumnRenamed("__group", "__of"))
    return own.join(first, F.col("__group").eqNullSafe(F.col("__of"))).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__at") - F.col("__before")).alias(to))


def beside(ranked: DataFrame, of: str, steps: tuple[int, ...], rank: str = "rank") -> DataFrame:
    """Adds of_<k>: the value of `of` k ranks on (before, if k is negative), null beyond the ends. Stretches of ranks are separate
    groups; a row near an end of one is copied to its neighbour."""
    stretch = lambda d: F.floor((F.col(rank) + d) / STRETCH)
    reach = max(abs(s) for s in steps)
    copies = ranked.withColumn("__s", F.explode(F.array_distinct(F.array(stretch(-reach), stretch(0), stretch(reach)))))
    w = Window.partitionBy("__s").orderBy(rank)
    out = copies.select("*", *((F.lead(of, s) if s > 0 else F.lag(of, -s)).over(w).alias(f"{of}_{s}") for s in steps))
    return out.filter(F.col("__s") == stretch(0)).drop("__s")


def bucketed(rows: DataFrame, bucket: Column, order: list, within: list[str], **values) -> DataFrame:
    """As Ordered.running(), without a stored table: `bucket` (a function that rises with the order, as a span of time) makes the
    groups. rows are read twice, so they should be cheap. Only one row a bucket is put in order, so spans have to be wide
    enough that they are few."""
    keyed = rows.withColumn("__k", bucket)
    key = [*within, "__k"]
    totals = keyed.groupBy(*key).agg(*(kind(arg).alias(k) for k, (kind, arg, _) in values.items()))
    others = totals.select(*(F.col(c).alias(f"__j{i}") for i, c in enumerate(key)), *(kind(k).over(rows_of(f, within, ["__k"], outer=True)).alias(f"__o_{k}") for k, (kind, _, f) in values.items()))
    here = keyed.select("*", *(kind(arg).over(rows_of(f, key, order)).alias(f"__i_{k}") for k, (kind, arg, f) in values.items()))
    both = here.join(others, [F.col(c) == F.col(f"__j{i}") for i, c in enumerate(key)])
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *(joined(v[0], F.col(f"__i_{k}"), F.col(f"__o_{k}")).alias(k) for k, v in values.items()))
