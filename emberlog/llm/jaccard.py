"""N-gram Jaccard join: MinHash banding, and links verified on full sets of word n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Carried, broadcast_if_small, written
from .graph import components
from .words import Words, blocks, give_back, mixed, powers, text_bytes


#: Numbers of one dense slice of texts by shingles.
DENSE = 2_000_000


@dataclass(frozen=True)
class JaccardConfig:
    """Links are pairs of texts whose sets of n-word shingles have a Jaccard similarity of threshold or more.

    bands follows from band_rows and the recall wanted of a pair just at the threshold. A bucket of at most small_bucket
    different texts is compared pair by pair; texts of larger buckets are compared in blocks of block texts. Neither limit
    drops anything.
    """

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.995
    band_rows: int = 7
    small_bucket: int = 16
    block: int = 256
    block_shingles: int = 400_000
    broadcast_rows: int = 1_000_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.band_rows))


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The hashes of each text's different runs of n words; words are split at ASCII white space."""
    words = Words(texts)
    up = powers(0xD6E8FEB86659FD93, n)
    count = max(0, len(words.numbers) - n + 1)
    runs = np.zeros(count, np.uint64)
    for k in range(n):
        runs += words.numbers[k : k + count] * up[k]
    runs = mixed(runs)
    ends = np.cumsum(words.counts)
    return [np.unique(runs[a : max(a, b - n + 1)]) for a, b in zip((ends - words.counts).tolist(), ends.tolist(), strict=True)]


def band_hashes(sets: list[np.ndarray], config: JaccardConfig) -> np.ndarray:
    """A row of band hashes for each set; sets must not be empty. The least value under each of bands * band_rows hashes."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    seeds = mixed(np.arange(1, 2 * config.bands * config.band_rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(sets), config.bands), np.uint64)
    for band in range(config.bands):
        h = np.full(len(sets), np.uint64(band + 1))
        for row in range(config.band_rows):
            k = band * config.band_rows + row
            value = joined * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]
            h = mixed(h ^ (np.minimum.reduceat(value ^ (value >> np.uint64(32)), starts) * np.uint64(0xD6E8FEB86659FD93)))
        out[:, band] = h
    return out


def parts_of(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    return [batch.slice(g[0], len(g)) for g in blocks(sizes, list(range(batch.num_rows)))]


def signatures(rows: DataFrame, config: JaccardConfig) -> DataFrame:
    """(node, doc, bands) of each row (node, doc, text); bands is empty where a text has fewer than n words."""

    def emit(batches):
        for batch in batches:
            give_back()
            for part in parts_of(batch):
                sets = shingles(text_bytes(part.column("text")), config.n)
                full = [i for i, s in enumerate(sets) if len(s)]
                lengths = np.zeros(len(sets), np.int64)
                lengths[full] = config.bands
                flat = band_hashes([sets[i] for i in full], config).reshape(-1).view(np.int64) if full else np.zeros(0, np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("doc"), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "doc", "bands"])

    return rows.mapInArrow(emit, "node long, doc long, bands array<long>")


def shingle_sets(rows: DataFrame, config: JaccardConfig) -> DataFrame:
    """(node, grams) of each row (node, text)."""

    def emit(batches):
        for batch in batches:
            give_back()
            for part in parts_of(batch):
                sets = shingles(text_bytes(part.column("text")), config.n)
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "grams"])

    return rows.mapInArrow(emit, "node long, grams array<long>")


def block_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All links between two blocks of texts (or within one): for each text the number of documents it is linked with, and the
    smallest text that its links reach here."""
    pdf = pdf.drop_duplicates("node")
    sizes = np.array([len(g) for g in pdf["grams"]], np.int64)
    _, inverse, counts = np.unique(np.concatenate(pdf["grams"].to_list()), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    row, shared = np.repeat(np.arange(len(pdf)), sizes), counts[inverse] > 1
    row, column = row[shared], number[inverse[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, step = np.zeros((len(pdf), len(pdf)), np.float32), max(1, DENSE // max(1, len(pdf)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        dense = np.zeros((len(pdf), min(step, int(column[-1]) + 1 - lo)), np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        common += dense @ dense.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    block = pdf["block"].to_numpy()
    if len(set(block)) > 1 or pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
        linked &= block[:, None] != block[None, :]  # pairs within one block belong to that block's own comparison
    links = linked @ pdf["copies"].to_numpy(np.int64)
    nodes = pdf["node"].to_numpy(np.int64)
    label = nodes.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            break
        label = new
    keep = links > 0
    del pdf, row, column, inverse, counts, number, order, common, linked
    give_back()  # several blocks are worked on at once in an executor
    return pd.DataFrame({"node": nodes[keep], "other": label[keep], "links": links[keep]})


def text_node(text: str) -> Column:
    """The node of a text, which all its copies share."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row for each document: doc_id, class_id, n_copies, n_links.

    class_id is the smallest doc_id of the documents that links reach; n_links counts the other documents that are linked with
    this one, copies of the same text included; n_copies those with just its text.

    Copies are one node of the search. A node's band hashes are its keys; nodes that share a key are candidates. Small buckets
    give pairs, which are made distinct before any set is fetched. Nodes that meet in large buckets are put together and
    compared all with all in blocks, of which only counts and one chain for each block leave a task: exact, and the work grows
    with the square of the number of different texts in such a group, but no task and no row count does. Then components.

    Null texts are empty. Texts of fewer than n words are linked only with copies. A null doc_id is never a class_id unless a
    class has no other; ids are whole numbers, and a text that is none stops the run. Repeated rows are copies. Other columns are not read; an empty table gives no rows.
    """
    return classes_of_rows(docs, doc_id, text, config).select(F.col("doc").alias("doc_id"), "class_id", "n_copies", "n_links")


def classes_of_rows(docs: DataFrame, doc_id: str, text: str, config: JaccardConfig) -> DataFrame:
    """(node, doc, class_id, head, n_copies, n_links) of each document, as near_duplicates() describes; head is the least node of
    those in the class that hold class_id."""
    rows = docs.select(text_node(text).alias("node"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    nodes = written(signatures(rows, config).groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
    bucket = Window.partitionBy("bucket")
    keys = nodes.select("node", F.explode("bands").alias("bucket")).withColumn("size", F.count("*").over(bucket)).filter("size > 1")
    keys = written(keys, "buckets")

    # Small buckets: distinct pairs of nodes.
    small = keys.filter(F.col("size") <= config.small_bucket).groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("m"))
    pairs = small.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*").distinct()

    # Large buckets: cells of nodes that such buckets join.
    large = keys.filter(F.col("size") > config.small_bucket)
    cells = written(components(large.groupBy("bucket").agg(F.min("node").alias("b")).join(large, "bucket").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "cell"), "cells")
    pairs = written(
        pairs.join(cells.select(F.col("node").alias("a"), F.col("cell").alias("ca")), "a", "left").join(cells.select(F.col("node").alias("b"), F.col("cell").alias("cb")), "b", "left").filter("ca is null or cb is null or ca <> cb").select("a", "b"),
        "pairs",
    )

    # Sets of the nodes that are candidates.
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(cells.select("node")).distinct().join(nodes.select("node", "doc", "copies"), "node"), "wanted")
    texts = rows.join(broadcast_if_small(wanted.select("node", F.col("doc").alias("_first")), wanted.count(), config.broadcast_rows), "node").filter(F.col("doc").eqNullSafe(F.col("_first")))
    sets = written(shingle_sets(texts.select("node", "text"), config).groupBy("node").agg(F.first("grams").alias("grams")), "sets")

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    linked = written(both.select("a", "b", common.alias("c"), F.size("ga").alias("x"), F.size("gb").alias("y")).filter(F.col("c") >= config.threshold * (F.col("x") + F.col("y") - F.col("c")) - 1e-6).select("a", "b"), "linked")

    in_cells = cells.join(sets, "node").join(wanted.select("node", "copies"), "node")
    counts = cells.join(sets.select("node", F.size("grams").alias("s")), "node").groupBy("cell").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / config.block), F.ceil(F.col("s") / config.block_shingles))
    dealt = in_cells.join(counts.select("cell", blocks.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    threshold = config.threshold
    # Dealt by all three, since rows that lie by cell would stay so: a group's blocks are different tasks' work.
    dealt = dealt.select("cell", "lo", "hi", "block", "node", "copies", "grams").repartition("cell", "lo", "hi")
    blocked = written(dealt.groupBy("cell", "lo", "hi").applyInPandas(lambda pdf: block_links(pdf, threshold), "node long, other long, links long"), "blocked")

    classes = components(linked.union(blocked.select("node", "other")))
    size = nodes.select("node", "copies")
    degree = linked.union(linked.select("b", "a")).join(size.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("copies").alias("links"))
    degree = degree.union(blocked.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("node", "doc", "copies").join(classes, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = found.groupBy("component").agg(F.min("doc").alias("class_id"), F.min(F.struct(F.col("doc").isNull(), "doc", "node")).getField("node").alias("head"))
    found = found.join(heads, "component").select("node", "class_id", "head", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("node", "doc").join(found, "node").select("node", "doc", "class_id", "head", (F.col("copies") - 1).alias("n_copies"), "n_links")


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates, with its columns.

    Rows with equal doc_id and text are one document and stay or go together. Ids don't have to be unique: of different texts
    with the smallest doc_id, or in a class of only null ids, the one of the least hash stays.
    """
    own = Carried(docs)
    found = classes_of_rows(own.rows, own.at(doc_id), own.at(text), config)
    stays = F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("head"))
    gone = written(found.filter(~stays).select(F.col("doc").alias("_gone"), F.col("node").alias("_node")).distinct(), "gone")
    same = F.col(own.at(doc_id)).cast("long").eqNullSafe(F.col("_gone")) & (text_node(own.at(text)) == F.col("_node"))
    kept = own.rows.join(broadcast_if_small(gone, gone.count(), config.broadcast_rows), same, "left_anti")
    return kept.select(*own.back())
