"""Benchmark decontamination: spaced seeds, joined with the test items', and verified around hits. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Carried, broadcast_if_small, row_key, written


@dataclass(frozen=True)
class SeedConfig:
    """A mask's 0s are ignored positions. With these masks, any window tokens of which at most max_substitutions differ hold a
    hit, and so do short_window of which one differs; an item that is shorter has to occur as it is. An item of fewer tokens
    than a mask spans is its own seed, under a mask of as many 1s.

    broadcast_seeds: the most seeds, counted, that are sent to all tasks; with more, both sides are shuffled.
    """

    masks: tuple[str, ...] = ("11110011", "11010111")
    window: int = 13
    max_substitutions: int = 2
    short_window: int = 10
    broadcast_seeds: int = 500_000

    @property
    def span(self) -> int:
        return max(map(len, self.masks))


def token_hashes(text: Column) -> Column:
    """Hashes of a text's tokens: runs of letters and digits, lower case. A null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_for(tests: DataFrame, tokens: str, config: SeedConfig) -> tuple[str, ...]:
    """The masks, and one of n 1s for each length n of items too short for them; there are fewer such lengths than a mask spans."""
    short = tests.select(F.size(tokens).alias("n")).filter(F.col("n") < config.span).distinct().collect()
    return (*config.masks, *("1" * r.n for r in sorted(short)))


def seeds(rows: DataFrame, tokens: str, position: str, masks: tuple[str, ...], own: bool, config: SeedConfig) -> DataFrame:
    """A row for each position of `tokens` and each mask that fits there, with the hash of the unmasked tokens. With own, a mask
    shorter than the others only fits tokens of just its length."""
    n, least = F.size(tokens), min(map(len, masks))
    at = rows.filter(n >= least).withColumn(position, F.explode(F.sequence(F.lit(0), n - least)))
    kept = []
    for k, mask in enumerate(masks):
        hashed = F.xxhash64(F.lit(k), *(F.get(F.col(tokens), F.col(position) + o) for o, c in enumerate(mask) if c == "1"))
        fits = n == len(mask) if own and k >= len(config.masks) else F.col(position) + len(mask) <= n
        kept.append(hashed if len(masks) == len(config.masks) and len(mask) == least else F.when(fits, hashed))
    return at.withColumn("seed", F.explode(F.array(*kept) if len(masks) == len(config.masks) else F.array_compact(F.array(*kept))))


def window_of(length: Column, config: SeedConfig) -> tuple[Column, Column]:
    """For an item of so many tokens: the tokens that are compared together, and how many of them must agree."""
    window = F.least(length, F.lit(config.window))
    spare = F.when(length >= config.window, config.max_substitutions).when(length >= config.short_window, 1).otherwise(0)
    return window, window - spare


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, config: SeedConfig) -> DataFrame:
    """(_key, _id, _item, _item_id, _best): the most agreeing tokens in a window of an item laid along a document. _item is a key
    of an item's id and tokens, so that items with a null or repeated id are told apart."""
    tests = items.select(F.col(item_id).alias("_item_id"), token_hashes(F.col(item_text)).alias("_it")).filter(F.size("_it") > 0).distinct()
    tests = written(tests.withColumn("_item", F.xxhash64("_item_id", F.col("_item_id").isNull(), "_it")), "items")
    masks = masks_for(tests, "_it", config)
    marks = written(seeds(tests, "_it", "_ipos", masks, True, config).select("seed", "_item", "_ipos", F.size("_it").alias("_len")), "seeds")
    n = marks.count()
    own = docs.select(row_key(doc_id, text).alias("_key"), F.col(doc_id).alias("_id"), token_hashes(F.col(text)).alias("_dt"))
    diagonal = (F.col("_pos") - F.col("_ipos")).alias("_diag")
    laid = F.transform(F.sequence(F.lit(0), F.col("_len") - 1), lambda k: F.when((k + F.col("_diag") >= 0) & (k + F.col("_diag") < F.size("_dt")), F.get(F.col("_dt"), k + F.col("_diag"))))
    if n <= config.broadcast_seeds:
        hits = seeds(own, "_dt", "_pos", masks, False, config).join(F.broadcast(marks), "seed").select("_key", "_id", "_dt", "_item", "_len", diagonal)
        hits = hits.select("_key", "_id", "_item", "_diag", laid.alias("_laid")).groupBy("_key", "_id", "_item", "_diag").agg(F.first("_laid").alias("_laid"))
    else:
        hits = seeds(own, "_dt", "_pos", masks, False, config).select("_key", "_pos", "seed").join(marks, "seed").select("_key", "_item", "_len", diagonal).distinct()
        hits = hits.join(own, "_key").select("_key", "_id", "_item", "_diag", laid.alias("_laid")).distinct()
    checked = hits.join(broadcast_if_small(tests, n, config.broadcast_seeds), "_item")
    window, need = window_of(F.size("_it"), config)
    agree = checked.withColumn("_agree", F.zip_with("_laid", "_it", lambda a, b: F.when(a == b, 1).otherwise(0))).withColumn("_w", window).withColumn("_need", need)
    # Only diagonals with enough agreement in all are looked at window by window.
    enough = agree.filter(F.aggregate("_agree", F.lit(0), lambda s, x: s + x) >= F.col("_need"))
    sums = F.transform(F.sequence(F.lit(0), F.size("_agree") - F.col("_w")), lambda i: F.aggregate(F.slice("_agree", i + 1, F.col("_w")), F.lit(0), lambda s, x: s + x))
    return enough.withColumn("_best", F.array_max(sums)).filter(F.col("_best") >= F.col("_need")).groupBy("_key", "_id", "_item", "_item_id").agg(F.max("_best").alias("_best"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", config: SeedConfig = SeedConfig()) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items, item_ids (comma-joined, in order), best_window.

    A document is contaminated if `window` consecutive tokens of an item, or all of a shorter item, stand in it with at most
    max_substitutions tokens replaced. Items without a token match nothing; one of very few tokens matches wherever they stand.

    Null and empty texts are never contaminated. A null doc_id is kept as null. Repeated rows give a row each, with the same
    result. Repeated items count once by id; those with a null id count once by tokens, and item_ids leaves them out. Empty
    tables on either side give no contamination. Other columns are not read.
    """
    found = overlaps(docs, items, doc_id, text, item_id, item_text, config).groupBy("_key").agg(F.array_sort(F.collect_set("_item_id")).alias("_items"), F.size(F.collect_set(F.when(F.col("_item_id").isNull(), F.col("_item")))).alias("_nameless"), F.max("_best").alias("_best"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("_key")).join(found, "_key", "left")
    return rows.select("doc_id", F.col("_items").isNotNull().alias("contaminated"), F.coalesce(F.size("_items") + F.col("_nameless"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.transform("_items", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"), F.coalesce("_best", F.lit(0)).cast("long").alias("best_window"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", config: SeedConfig = SeedConfig()) -> DataFrame:
    """The documents without contaminated ones, with their columns; nulls and repeats as in contamination()."""
    bad = written(overlaps(docs, items, doc_id, text, item_id, item_text, config).select("_key").distinct(), "contaminated")
    own = Carried(docs)
    kept = own.rows.withColumn("_key", row_key(own.at(doc_id), own.at(text))).join(broadcast_if_small(bad, bad.count(), config.broadcast_seeds), "_key", "left_anti")
    return kept.select(*own.back())
