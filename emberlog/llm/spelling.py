"""Spelling variants: words at edit distance one by a bit-sliced position index over a vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import broadcast_if_small, written
from .words import give_back

#: Runs of letters; A to Z are lower-cased before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Queries of one step of the recurrences, so that a step's sets stay in cache.
QUERIES = 512


@dataclass(frozen=True)
class SpellingConfig:
    """min_chars, min_count: what makes a word. every: a run of a document is damaged if every divides its checksum, None: never.
    times: a form is at least so many times as frequent. slice: words of one index, in bits; larger blocks are split into several.
    broadcast_rows: the list of such blocks is broadcast up to so many rows, which are counted."""

    min_chars: int = 5
    min_count: int = 3
    every: int | None = 97
    times: int = 2
    slice: int = 4096
    broadcast_rows: int = 1_000_000


def damaged(words: list[str], doc_id: str, every: int) -> dict[str, str]:
    """The runs of a document that lose a letter, by their checksum with its id, and what they become."""
    head, out = zlib.crc32(f"{doc_id}:".encode()), {}
    for w in set(words):
        h = zlib.crc32(w.encode(), head)
        if h % every == 0:
            k = h % len(w)
            out[w] = w[:k] + w[k + 1 :]
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n) of all words of at least min_chars letters and min_count occurrences. Tasks count before the shuffle; a task holds
    one document's runs and at most about HELD_WORDS different words."""
    every, least = config.every, config.min_chars

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w, n in held.items() if n > 0 and len(w) >= least]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = RUN.findall((raw.as_py() or b"").lower().decode())
                held.update(words)
                hit = damaged(words, key, every) if every else {}
                if hit:
                    own = Counter(words)
                    for w, new in hit.items():
                        held[w] -= own[w]
                        held[new] += own[w]
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()
        give_back()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("binary"))
    counted = rows.mapInArrow(emit, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= config.min_count)


class PositionIndex:
    """Bitsets over a slice of a vocabulary, one for each (position, letter): bit i is set if word i has the letter there.

    Words are numbered by falling count, then by code points, so the first bit of any set is its most frequent word.
    """

    def __init__(self, words: list[str], counts: np.ndarray, shorter: int):
        """Words of `shorter` or `shorter` + 1 letters."""
        letters = code_points(words, shorter + 1)
        order = np.lexsort((*letters.T[::-1], -counts))
        self.words, self.counts, letters = [words[i] for i in order], counts[order], letters[order]
        self.alphabet = np.unique(letters)
        self.blocks = -(-len(words) // 64)
        own, bits = np.searchsorted(self.alphabet, letters), np.arange(len(words))
        one_hot = np.zeros((shorter + 3, len(self.alphabet) + 1, self.blocks * 64), bool)  # a place before, and one behind, are empty
        for p in range(shorter + 1):
            one_hot[p + 1, own[:, p], bits] = letters[:, p] > 0
        self.sets = packed(one_hot)
        longer = letters[:, shorter] > 0
        self.of_length = {shorter: packed(padded(~longer, self.blocks)), shorter + 1: packed(padded(longer, self.blocks))}

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Letters as places in the alphabet; those that no word has lead to empty sets."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, len(self.alphabet))

    def near(self, letters: np.ndarray, shorter: int, prefix: int, same_prefix: bool) -> np.ndarray:
        """For queries of one length (code points, a row each), the words that differ by one edit, as rows of bits: of those that
        share the query's first `prefix` letters, or of those that don't.

        Going along a query, `same` holds the words that agree so far; the others have used their edit: `replaced` go on at the
        same position, `longer` (with one letter more) one position ahead and `less` (without one) one behind.
        """
        n = letters.shape[1]
        code, sets = self.codes(letters), self.sets
        same = np.full((len(letters), self.blocks), ~np.uint64(0))
        replaced, longer, less = (np.zeros_like(same) for _ in range(3))
        shared = same.copy() if prefix == 0 else None
        for p in range(n):
            here = sets[p + 1, code[:, p]]
            if n == shorter:
                replaced = (replaced & here) | (same & ~here)
                longer = (longer | same) & sets[p + 2, code[:, p]]
            else:
                less = (less & sets[p, code[:, p]]) | same
            same &= here
            if p + 1 == prefix:
                shared = same.copy()
        found = (replaced & self.of_length[n]) | ((longer | same) & self.of_length[n + 1]) if n == shorter else less & self.of_length[shorter]
        return found & (shared if same_prefix else ~shared)


def code_points(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"<U{width}").view(np.uint32).reshape(-1, width)


def padded(flags: np.ndarray, blocks: int) -> np.ndarray:
    return np.concatenate([flags, np.zeros(blocks * 64 - len(flags), bool)])


def packed(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def first_bits(rows: np.ndarray) -> np.ndarray:
    """The number of each row's first bit that is set; rows must not be empty."""
    block = (rows != 0).argmax(axis=1)
    word = rows[np.arange(len(rows)), block]
    return block * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def search(index: PositionIndex, words: list[str], shorter: int, half: int) -> list[tuple[str, int, str, int]]:
    """(word, number of near words, the most frequent of them, its count) of the queries that have any in the index."""
    out = []
    for n in (shorter, shorter + 1):
        own = [w for w in words if len(w) == n]
        for at in range(0, len(own), QUERIES):
            part = own[at : at + QUERIES]
            found = index.near(code_points(part, n), shorter, shorter // 2, half == 0)
            count = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(count)
            if len(hit):
                best = first_bits(found[hit])
                out += [(part[i], int(count[i]), index.words[b], int(index.counts[b])) for i, b in zip(hit.tolist(), best.tolist(), strict=True)]
    return out


def near_words(vocabulary: DataFrame, config: SpellingConfig) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have a near word; form is the most frequent of them, the first in
    code-point order of ties.

    One edit leaves the first half of a word, or else the rest, as it is. So the vocabulary falls into blocks: for each pair of
    lengths (t, t + 1) one by the first half of t letters and one by the last letters. Small blocks share a slice, a larger one is
    split into several, and its words are queries of each. A pair counts in the block of the first half if its words share that,
    else in the other: once in all, so counts and best words add up and no pairs are written.
    """
    size, least = config.slice, config.min_chars

    tiers = F.array(F.length("word"), F.length("word") - 1)
    split = vocabulary.select("word", "n", F.explode(tiers).alias("tier")).filter(F.col("tier") >= least).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    cut = F.floor(F.col("tier") / 2).cast("int")
    block = F.when(F.col("half") == 0, F.substring("word", F.lit(1), cut)).otherwise(F.substring("word", F.length("word") - F.col("tier") + cut + 1, F.col("tier") - cut))
    split = split.withColumn("block", block)
    key = ["tier", "half", "block"]
    large = written(split.groupBy(*key).count().filter(F.col("count") > size).select(*key, F.ceil(F.col("count") / size).alias("parts")), "large-blocks")
    dealt = split.join(broadcast_if_small(large, large.count(), config.broadcast_rows), key, "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    # Words of the part itself come first: they make its index; the block's other words are only queries of it.
    dealt = dealt.select(*key, "part", (F.col("own") != F.col("part")).alias("asks"), "word", "n")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows. Whole blocks are gathered until a slice is full."""
        held: list[tuple] = []
        place, index = None, None

        def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = search(index, [r[5] for r in rows], *place) if index else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])

        def close() -> Iterator[pa.RecordBatch]:
            """An index of the rows that are held, asked for all of them."""
            nonlocal index, place
            if held:
                place = held[0][:2]
                index = PositionIndex([r[5] for r in held], np.array([r[6] for r in held], np.int64), place[0])
                yield from answer(held)
                held.clear()

        asking: list[tuple] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = row[:4]
                if here != last:
                    if asking:
                        yield from answer(asking)
                        asking.clear()
                    if held and (len(held) >= size or held[0][:2] != row[:2]):
                        yield from close()
                    last, index = here, None
                if row[4]:
                    yield from close()
                    asking.append(row)
                    if len(asking) >= 8 * QUERIES:
                        yield from answer(asking)
                        asking.clear()
                else:
                    held.append(row)
        if asking:
            yield from answer(asking)
        yield from close()
        give_back()

    order = [*key, "part", "asks"]
    found = dealt.repartition(*key, "part").sortWithinPartitions(*order).mapInArrow(emit, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): where forms lead. Each round doubles the way; a form is more frequent than its word by a
    factor, so ways are no longer than the logarithm of the largest count and there is no circle."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """One row for each word of the documents: word, form, root, n, n_near, form_n.

    Runs of letters (A to Z, lower-cased, and U+00C0 to U+00FF) of whole texts are counted, after the damage that a run's checksum
    with its document's id brings. Words of at least min_chars letters and min_count occurrences make the vocabulary. Two words are
    near if one letter inserted, deleted or replaced makes one the other. A word's form is its most frequent near word (the first in
    code-point order of ties), if that is at least `times` as frequent, else null; root is where forms lead, the word itself
    without one. n_near counts near words.

    Near words come from a bit-sliced position index, see PositionIndex and near_words().

    A null text has no runs; a null doc_id counts as empty in checksums. Repeated rows count each. No words give no rows. Other
    columns are not read.
    """
    vocabulary = written(word_counts(docs, doc_id, text, config), "vocabulary")
    near = written(near_words(vocabulary, config), "near").withColumnRenamed("word", "_word")
    both = vocabulary.join(near, F.col("word") == F.col("_word"), "left")
    takes = F.col("form_n") >= config.times * F.col("n")
    both = written(both.select("word", F.when(takes, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n")), "forms")
    lead = roots(both.filter("form is not null")).withColumnRenamed("word", "_word")
    return both.join(lead, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
