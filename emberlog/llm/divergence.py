"""Source divergence: term frequencies of the sources of a language compared pair by pair, by a frequent-pattern tree of term rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import broadcast_if_small, written
from .words import give_back

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Numbers (term, source, count) that a task holds before it hands them on.
HELD_TERMS = 200_000
#: Different paths of one tree.
PATHS = 16_384


@dataclass(frozen=True)
class DivergenceConfig:
    """min_docs: documents of a language that hold a kept term. smooth: what is added to each count. scale: probabilities are whole
    numbers of 1 / scale. top: ranks of terms. broadcast_rows: the table of sources is broadcast up to so many rows, counted."""

    min_docs: int = 30
    smooth: int = 5
    scale: int = 1_000_000_000
    top: int = 50
    broadcast_rows: int = 100_000


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, docs, n), added up in tasks, so with several rows of a term; a row with a null term for each source."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter[str]] = {}
        docs: dict[tuple[str, str], Counter[str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, terms in n.items():
                names = [None, *terms]
                columns = [pa.array([group[0]] * len(names), pa.string()), pa.array([group[1]] * len(names), pa.string()), pa.array(names, pa.string())]
                columns += [pa.array([0, *map(docs[group].__getitem__, terms)], pa.int64()), pa.array([0, *terms.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])
            n.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for raw, *group in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = tuple(group)
                if own not in n:
                    n[own], docs[own] = Counter(), Counter()
                before = len(n[own])
                terms = TERM.findall(raw.as_py().lower().decode())  # of bytes, lower() changes A to Z only
                n[own].update(terms)
                docs[own].update(set(terms))
                held += len(n[own]) - before
                if held >= HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()
        give_back()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)))
    return rows.mapInArrow(emit, "lang string, source string, term string, docs long, n long")


def probability(count: Column, total: Column, terms: Column, config: DivergenceConfig) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)), exactly; 0 if there are no terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = wide(wide(count + config.smooth) * config.scale)
    below = wide(total + config.smooth * terms)
    return F.when(terms > 0, ((top - top % below) / below).cast("long") + 1).otherwise(F.lit(0)).cast("long")


class PatternTree:
    """A frequent-pattern tree of term rows: a row is a path of nodes (source, probability) in the order of sources, and rows with
    equal beginnings share nodes. A node has its parent and the number of rows through it.

    Paths come sorted, so a level's new nodes are where a path's node or anything above it differs from the path before.
    """

    def __init__(self, offsets: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: np.ndarray):
        """Path i holds the nodes offsets[i] .. offsets[i + 1] - 1: source numbers, p and zero (p of a count of 0); rows[i] rows take
        it."""
        length = np.diff(offsets)
        node, made = np.full(len(length), -1, np.int64), 0
        self.levels: list[tuple[int, int]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        for level in range(int(length.max(initial=0))):
            deep = np.flatnonzero(length > level)
            at = offsets[deep] + level
            own_source, own_p, above = source[at], p[at], node[deep]
            new = np.ones(len(deep), bool)
            new[1:] = (own_source[1:] != own_source[:-1]) | (own_p[1:] != own_p[:-1]) | (above[1:] != above[:-1])
            number = made + np.cumsum(new) - 1
            first = np.flatnonzero(new)
            parts.append((own_source[first], own_p[first], zero[at][first], above[first], np.add.reduceat(rows[deep], first)))
            node = np.full(len(length), -1, np.int64)
            node[deep] = number
            self.levels.append((made, made + len(first)))
            made += len(first)
        self.source, self.p, self.zero, self.parent, self.rows = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5

    def corrections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(s, r, value) of pairs of sources, r before s: what rows with both lack once each count has been compared with the other
        source's zero: |p - p'| - |p - zero'| - |zero - p'| + |zero - zero'|, once for a node and each ancestor, times the node's
        rows."""
        width = int(self.source.max(initial=0)) + 1
        keys, values = [], []
        for lo, hi in self.levels[1:]:
            node = np.arange(lo, hi)
            p, zero, rows = self.p[node], self.zero[node], self.rows[node]
            up = self.parent[node]
            while up[0] >= 0:  # nodes of a level are equally deep
                q, none = self.p[up], self.zero[up]
                value = (np.abs(p - q) - np.abs(p - none) - np.abs(zero - q) + np.abs(zero - none)) * rows
                key, where = np.unique(self.source[node] * width + self.source[up], return_inverse=True)
                sums = np.zeros(len(key), np.int64)
                np.add.at(sums, where, value)
                keys.append(key)
                values.append(sums)
                up = self.parent[up]
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, where, np.concatenate(values))
        return key // width, key % width, sums


def tree_corrections(paths: DataFrame) -> DataFrame:
    """(lang, a, b, value) for sources a > b of sorted rows (lang, path: array of (s, p, z), rows): trees of at most PATHS paths of one
    language, one after another."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(lang: str, part: pa.RecordBatch) -> pa.RecordBatch:
            path = part.column("path")
            flat = path.flatten()
            offsets = path.offsets.to_numpy() - path.offsets[0].as_py()
            built = PatternTree(offsets.astype(np.int64), *(flat.field(c).to_numpy() for c in ("s", "p", "z")), part.column("rows").to_numpy())
            a, b, value = built.corrections()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], names=["lang", "a", "b", "value"])

        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield tree(held[0].column("lang")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            ends = [i for i in range(1, len(langs)) if langs[i] != langs[i - 1]]
            for lo, hi in zip([0, *ends], [*ends, len(langs)], strict=True):
                if held and (held[0].column("lang")[0].as_py() != langs[lo] or sum(b.num_rows for b in held) + hi - lo > PATHS):
                    yield from close()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        yield from close()
        give_back()

    return paths.mapInArrow(emit, "lang string, a long, b long, value long")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """How the sources of each language differ in their words: rows (lang, source, part, item, value, rank).

    Terms are runs of letters (A to Z, lower-cased, and all beyond ASCII) of whole texts; a language keeps those in at least
    min_docs of its documents. A source's probability of a kept term is 1 + floor(scale * (count + smooth) / (N + smooth * V)), with
    N its kept occurrences and V the language's kept terms. Part `pair`: item is another source of the language, value the sum of
    the differences of the probabilities over all kept terms. Part `term`: item is a kept term that the source has and that is more
    probable there than in the language, value the difference; `top` ranks. Ranks fall by value, then rise by item.

    The pairs come from a frequent-pattern tree, see PatternTree: every kept term is a row of its counts by source that aren't 0.
    With all counts 0 a pair differs by V times the difference of its zeros; each count other than 0 corrects that against all
    sources' zeros, from a histogram of counts; and rows with both counts correct it once for a node of the tree and each of its
    ancestors. Equal rows are one with a multiplicity, and rows are sorted and dealt by range, so that equal beginnings meet.

    Tasks add up terms before the shuffle. Null texts, languages and sources are ''. Repeated rows count each. A language without
    kept terms has pairs of value 0. A column is read by its name only; others aren't. An empty table gives no rows.
    """
    partial = term_counts(docs, text, lang, source).repartition("lang", "term")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    in_lang = Window.partitionBy("lang", "term")
    counts = counts.select("*", F.sum("docs").over(in_lang).alias("_docs"), F.sum("n").over(in_lang).alias("all"), (F.row_number().over(in_lang.orderBy("source")) == 1).cast("long").alias("new"))
    kept = written(counts.filter((F.col("_docs") >= config.min_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "all", "new"), "terms")
    has = F.col("term").isNotNull()

    # Groups with N, V, the language's N, p of a count of 0, and a number in the order of sources.
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(has, F.col("new")).otherwise(0)).alias("new"))
    by_lang = by_source.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("new").alias("terms"))
    groups = by_source.drop("new").join(by_lang, "lang").withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = written(groups.withColumn("z", probability(F.lit(0).cast("long"), F.col("total"), F.col("terms"), config)), "groups")
    size = groups.count()

    terms = kept.filter(has).join(broadcast_if_small(groups, size, config.broadcast_rows), ["lang", "source"])
    terms = terms.select("lang", "source", "term", "s", "z", probability(F.col("n"), F.col("total"), F.col("terms"), config).alias("p"), probability(F.col("all"), F.col("lang_total"), F.col("terms"), config).alias("q"))

    paths = terms.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "p", "z"))).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("rows"))
    both = tree_corrections(paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path"))

    # Each count other than 0 against the zeros of all other sources of the language, both ways.
    single = terms.groupBy("lang", "s", "z", "p").agg(F.count("*").alias("m"))
    other = broadcast_if_small(groups.select("lang", F.col("s").alias("b"), F.col("z").alias("zb")), size, config.broadcast_rows)
    single = single.join(other, "lang").filter("s <> b").groupBy("lang", F.col("s").alias("a"), "b").agg(F.sum(F.expr("m * (abs(p - zb) - abs(z - zb))")).alias("value"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    extra = both.union(single).select("lang", ways.alias("ways"), "value").groupBy("lang", "ways.a", "ways.b").agg(F.sum("value").alias("extra"))

    base = groups.select("lang", "source", F.col("s").alias("a"), F.col("z").alias("za"), "terms").join(broadcast_if_small(groups.select("lang", F.col("source").alias("item"), F.col("s").alias("b"), F.col("z").alias("zb")), size, config.broadcast_rows), "lang")
    pairs = base.filter("a <> b").join(extra, ["lang", "a", "b"], "left")
    value = F.expr("terms * abs(za - zb)") + F.coalesce("extra", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    more = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.top)
    return pairs.unionByName(more)
