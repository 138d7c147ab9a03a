"""Suffix-array dedup by prefix-free parsing: removes bytes of strings that start at more than one place of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.graph import Ordered, global_rank

from .base import Carried, broadcast_if_small, row_key, written
from .words import BLOCK_BYTES, Hashed, give_back, mixed, signed


#: Bytes of open segments that are parsed at once.
PARSE_BYTES = 250_000


@dataclass(frozen=True)
class SubstringConfig:
    """length: bytes of a string that counts as repeated. spacings: for each round, in how many places a trigger is looked for;
    the last is 1: the places that are left are put in corpus order. gram: bytes of the rolling hash that picks triggers.
    modulus: in the last round, one place in about so many is a trigger."""

    length: int = 200
    spacings: tuple[int, ...] = (96, 16, 1)
    gram: int = 8
    modulus: int = 16
    broadcast_rows: int = 1_000_000


def triggers(hashed: Hashed, n: int, spacing: int, gram: int) -> np.ndarray:
    """For each place x, the place of the least rolling hash in x .. x+spacing-1, the first of ties: what a string of enough
    bytes has as its trigger depends on its bytes alone."""
    grams = n - gram + 1
    at = np.arange(grams)
    least = ((hashed.sums[gram:] - hashed.sums[:grams]) * hashed.back[:grams] * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)
    least |= at.astype(np.uint64)
    reach = 1
    while reach < spacing:
        step = min(reach, spacing - reach)
        np.minimum(least[:-step], least[step:], out=least[:-step])
        least = least[:-step]
        reach += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(rows: DataFrame, config: SubstringConfig, spacing: int) -> DataFrame:
    """(phrase, context, _key, lo, hi, times) for runs of places lo..hi whose strings share a trigger.

    phrase: the bytes from the trigger on that all strings with that trigger hold. context: all bytes of the run's strings.
    Equal strings have equal phrases, at the same distance. Only places in the column `active` (of lo, hi), if there is one.

    Of runs of one block with equal phrase and context the first stands for all, `times` of them; the others, which are repeated
    already, have times 0 and a phrase of their own. So a passage with very many copies meets in as many rows as there are
    blocks.
    """
    length, gram = config.length, config.gram

    def emit(batches):
        for batch in batches:
            give_back()
            keys, texts = batch.column("_key").to_pylist(), batch.column("_text")
            active = ranges_of(batch.column("active")) if "active" in batch.schema.names else None
            block, size = [], 0
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                if raw.size >= length:
                    block.append((keys[i], np.frombuffer(raw, np.uint8), active[i] if active else None))
                    size += raw.size
                if block and (size >= BLOCK_BYTES or i == batch.num_rows - 1):
                    yield parse(block)
                    block, size = [], 0

    def parse(block) -> pa.RecordBatch:
        sizes = np.array([len(raw) for _, raw, _ in block], np.int64)
        first = np.cumsum(sizes) - sizes
        raw = np.concatenate([raw for _, raw, _ in block])
        if block[0][2] is None:
            wanted = np.ones(len(raw), bool)
        else:
            wanted = covered(len(raw), *(np.concatenate([ends[k] + at for at, (_, _, ends) in zip(first, block, strict=True)]) for k in (0, 1)))
        for at, n in zip(first, sizes, strict=True):
            wanted[at + n - length + 1 : at + n] = False
        places = np.flatnonzero(wanted)
        hashed = Hashed(raw)
        trigger = triggers(hashed, len(raw), spacing, gram)[places]
        new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (places[1:] != places[:-1] + 1)))) if len(places) else places
        lo, hi, trigger = places[new], places[np.append(new[1:], len(places)) - 1] if len(places) else places, trigger[new]
        of = np.searchsorted(first, lo, side="right") - 1
        phrase, context = hashed.run(trigger, length - spacing + 1), hashed.run(lo, hi + length - lo)
        keys = np.array([k for k, _, _ in block], np.int64)[of]
        _, head, counts = np.unique(phrase ^ mixed(context), return_index=True, return_counts=True)
        times = np.zeros(len(lo), np.int32)
        times[head] = counts
        start = (lo - first[of]).astype(np.int32)
        phrase = np.where(times > 0, phrase, mixed(mixed(keys.view(np.uint64)) + start.astype(np.uint64)))
        return pa.RecordBatch.from_arrays([signed(phrase), signed(context), pa.array(keys), pa.array(start), pa.array((hi - first[of]).astype(np.int32)), pa.array(times)], names=["phrase", "context", "_key", "lo", "hi", "times"])

    return rows.mapInArrow(emit, "phrase long, context long, _key long, lo int, hi int, times int")


def settled(found: DataFrame) -> DataFrame:
    """(_key, lo, hi, repeated, open) of runs whose phrase is there more than once.

    repeated: the same context is there again, so all strings of the run are repeated. open: strings of the run have to be
    looked at in shorter runs, since the context is there once, or since another run of the phrase is open and this one is the
    first with its context.
    """
    found = found.repartition("phrase")
    same, exact = Window.partitionBy("phrase"), Window.partitionBy("phrase", "context")
    copy, own = F.col("times") == 0, F.struct("_key", "lo")
    out = found.withColumn("n", F.when(copy, 2).otherwise(F.sum("times").over(exact)))
    out = out.withColumn("first", F.min(own).over(exact) == own).withColumn("all", F.sum("times").over(same)).withColumn("lone", F.max(F.col("n") == 1).over(same))
    open_ = ~copy & ((F.col("n") == 1) | (F.col("lone") & F.col("first")))
    out = out.filter(copy | (F.col("all") > 1)).select("_key", "lo", "hi", (F.col("n") > 1).alias("repeated"), open_.alias("open"))
    return out.filter("repeated or open")


def ranges_of(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's lo and hi, of an array of struct of lo and hi."""
    flat, at = column.flatten(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy()))).tolist()
    lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
    return [(lo[a:b], hi[a:b]) for a, b in zip(at, at[1:])]


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the places 0 .. n-1 lie in any range lo..hi; a hi beyond them is taken as the last."""
    edge = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(hi + 1, n), minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def open_segments(ends: tuple[np.ndarray, np.ndarray], n: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of places lo..hi at which a string of `length` bytes starts, of a text of n bytes."""
    lo, hi = ends[0], np.minimum(ends[1], n - length)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1] + 1))) if len(lo) else lo
    return list(zip(lo[new].tolist(), reach[np.append(new[1:], len(lo)) - 1].tolist(), strict=True)) if len(lo) else []


def parsed(rows: DataFrame, config: SubstringConfig) -> DataFrame:
    """The prefix-free parse of the open segments of rows (_key, _text, active): (_key, row, seg, j, lo, bytes, own).

    row numbers the rows, since repeated rows have one _key; it is part of a stored table, so it stays what it is.
    Triggers are places whose rolling hash is 0 by the modulus, so they depend on their own bytes alone. With lo null, bytes is
    phrase j of a segment: from its trigger to the end of the next one's gram. With lo, it is what place lo has before phrase j:
    the suffix of a phrase, up to the end of the gram that phrase j starts with; own is the hash of the place's string. No
    phrase or suffix is a prefix of another, as a trigger ends it, unless the segment or the string ends first.
    """
    length, gram, modulus = config.length, config.gram, np.uint64(config.modulus)

    def emit(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            give_back()
            keys, texts, active = batch.column("_key").to_pylist(), batch.column("_text"), ranges_of(batch.column("active"))
            block, size = [], 0
            for i in range(batch.num_rows):
                row += 1
                raw = texts[i].as_py()
                for lo, hi in open_segments(active[i], len(raw), length):
                    for start in range(lo, hi + 1, PARSE_BYTES):  # a very long segment is taken in pieces that overlap by a string
                        end = min(hi, start + PARSE_BYTES - 1)
                        block.append((keys[i], start, end - start + 1, row, raw[start : end + length]))
                        size += end - start + length
                        if size >= PARSE_BYTES:
                            yield parse(block)
                            block, size = [], 0
            if block:
                yield parse(block)

    def parse(block) -> pa.RecordBatch:
        text = b"".join(t for *_, t in block)
        keys, lo, n, row = (np.array([x[k] for x in block], np.int64) for k in range(4))
        first = np.cumsum([0, *(len(t) for *_, t in block)])
        hashed = Hashed(np.frombuffer(text, np.uint8))
        at = np.flatnonzero(hashed.run(np.arange(len(text) - gram + 1), gram) % modulus == 0)
        of = np.searchsorted(first, at, side="right") - 1
        inside = at + gram <= first[of + 1]
        at, of = at[inside], of[inside]
        number = np.arange(len(at)) - np.searchsorted(at, first)[of]
        ahead, ahead_of = np.append(at, 0), np.append(of, -1)
        closes = np.minimum(np.where(ahead_of[1:] == of, ahead[1:] + gram, first[of + 1]), at + length)
        seg = np.repeat(np.arange(len(n)), n)
        places = np.arange(len(seg)) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
        j = np.searchsorted(at, places)
        ends = np.where(ahead_of[j] == seg, np.minimum(ahead[j] + gram, places + length), places + length)
        own_number = j - np.searchsorted(at, first)[seg]
        strings = [text[p:e] for p, e in zip(np.concatenate([places, at]).tolist(), np.concatenate([ends, closes]).tolist(), strict=True)]
        which = np.concatenate([seg, of])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys[which]), pa.array(row[which]), pa.array(lo[which].astype(np.int32)), pa.array(np.concatenate([own_number, number]).astype(np.int32)), pa.array(np.concatenate([places - first[seg] + lo[seg], at]).astype(np.int32), mask=np.arange(len(which)) >= len(seg)),
                pa.array(strings, pa.binary()), pa.array(np.concatenate([hashed.run(places, length), (at - first[of]).astype(np.uint64)]).view(np.int64)),
            ],
            names=["_key", "row", "seg", "j", "lo", "bytes", "own"],
        )

    return rows.mapInArrow(emit, "_key long, row long, seg int, j int, lo int, bytes binary, own long")


def parse_suffixes(parse: DataFrame, length: int) -> DataFrame:
    """(row, seg, j, suffix): from each phrase of a segment on, the ranks of as many phrases as hold `length` bytes. parse: rows
    (row, seg, phrases: array of struct of j, own (where it starts) and rank, in order)."""

    def emit(batches):
        for batch in batches:
            phrases = batch.column("phrases")
            flat = phrases.flatten()
            count = np.diff(phrases.offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), count)
            ranks, starts = flat.field("rank").to_numpy(), flat.field("own").to_numpy() + (of << 40)  # segments lie far apart
            each = np.arange(len(starts))
            take = np.searchsorted(starts, starts + length) - each
            offsets = np.concatenate(([0], np.cumsum(take)))
            suffix = ranks[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - each, take)]
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(rows), batch.column("seg").take(rows), flat.field("j"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(suffix))], names=["row", "seg", "j", "suffix"])

    return parse.mapInArrow(emit, "row long, seg int, j int, suffix array<long>")


def in_corpus_order(rows: DataFrame, config: SubstringConfig) -> DataFrame:
    """(_key, lo, hi) of open places of rows (_key, _text, active) whose string starts at another open place too.

    The dictionary's suffix array ranks the different suffixes of phrases by their bytes; the parse's suffix array ranks every
    phrase of the parse by the phrases that follow. A place's own suffix and then the phrase behind it put all places in the
    order of their texts: both arrays and their combination are sorts partitioned by range of prefixes. Strings that are equal
    stand together in it, so each place is compared with its neighbours.
    """
    parse = written(parsed(rows, config), "parse")
    phrases, places = parse.filter("lo is null"), parse.filter("lo is not null")
    dictionary = global_rank(phrases.select("bytes").distinct(), F.col("bytes"))
    ranked = phrases.join(dictionary, "bytes").groupBy("row", "seg").agg(F.array_sort(F.collect_list(F.struct("j", "own", "rank"))).alias("phrases"))
    followed = global_rank(written(parse_suffixes(ranked, config.length), "parse-suffixes"), F.col("suffix"), F.col("row"), F.col("seg"), F.col("j"), to="parse_rank")
    suffixes = global_rank(places.select("bytes").distinct(), F.col("bytes"), to="suffix_rank")
    both = places.join(suffixes, "bytes").join(followed.select("row", "seg", "j", "parse_rank"), ["row", "seg", "j"], "left")
    corpus = both.select("_key", "lo", "suffix_rank", F.coalesce("parse_rank", F.lit(0).cast("long")).alias("parse_rank"), "own")
    place = F.struct("suffix_rank", "parse_rank", "own", "_key", "lo")
    seen = Ordered(corpus, *map(F.col, ("suffix_rank", "parse_rank", "own", "_key", "lo"))).running(before=(F.max, place, "before"), after=(F.min, place, "after"))
    return seen.filter((F.col("before.own") == F.col("own")) | (F.col("after.own") == F.col("own"))).select("_key", "lo", F.col("lo").alias("hi"))


def with_ranges(rows: DataFrame, ranges: DataFrame, to: str, config: SubstringConfig) -> DataFrame:
    """Rows that have ranges, with them as an array; texts of other rows are not shuffled if the keys are few."""
    lists = ranges.groupBy("_key").agg(F.collect_set(F.struct("lo", "hi")).alias(to))  # repeated rows have the same ranges
    keys = ranges.select("_key").distinct()
    return rows.join(broadcast_if_small(keys, keys.count(), config.broadcast_rows), "_key", "left_semi").join(lists, "_key")


def repeated_ranges(rows: DataFrame, config: SubstringConfig) -> DataFrame:
    """(_key, lo, hi): places of rows (_key, _text) where a string starts that also starts elsewhere."""
    parts, todo = [], rows
    for spacing in config.spacings:
        if spacing == 1:
            parts.append(in_corpus_order(todo, config))
            continue
        level = written(settled(phrases(todo, config, spacing)), "phrases")
        parts.append(level.filter("repeated").select("_key", "lo", "hi"))
        todo = with_ranges(rows, level.filter("open").select("_key", "lo", "hi"), "active", config)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cut_ranges(config: SubstringConfig):
    length = config.length

    @F.arrow_udf("struct<n_removed: bigint, n_spans: bigint, kept: binary>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        removed, spans, kept = [], [], []
        for raw, (lo, hi) in zip(texts, ranges_of(ranges), strict=True):
            text = np.frombuffer(raw.as_buffer(), np.uint8)
            gone = covered(len(text), lo, hi + (length - 1))
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
            kept.append(text[~gone].tobytes())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["n_removed", "n_spans", "kept"])

    return cut


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: SubstringConfig = SubstringConfig(), to: str = "repeats") -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts anywhere else in the corpus, the same document
    included. Adds the struct column `to`: n_bytes, n_removed, n_spans (maximal removed runs), kept (the rest as bytes).

    A prefix-free parse at the scale of a corpus, in rounds. In the first rounds triggers are places of locally least rolling
    hash, so that every string of the length has one and its choice depends on the string alone. The phrase at a trigger goes
    into a dictionary, which groups all its occurrences in the corpus; in it the parse around each occurrence (its context) is
    compared: equal (phrase, context) settle a whole run of places at once, without a row for each. Runs that differ from all
    others of their phrase, at the ends of repeats, are parsed again with denser triggers; of each other context one occurrence
    goes along, to be met there. What is then left open is a small part of the corpus, and is put in corpus order by suffix
    arrays of its dictionary and parse, see in_corpus_order(). Equality is that of 64-bit hashes of the bytes.

    Strings are judged on the input. A null text is empty; texts shorter than `length` keep all bytes. Rows with equal doc_id
    and text are separate documents, and so repeat one another. A column of the name `to` is replaced; other columns stay,
    whatever their names. An empty table gives none.
    """
    own = Carried(docs, to)
    of = F.coalesce(F.col(own.at(text)).cast("binary"), F.lit(b""))
    keyed = own.rows.withColumn("_key", row_key(own.at(doc_id), own.at(text)))
    ranges = written(repeated_ranges(keyed.select("_key", of.alias("_text")), config), "ranges")
    hit = with_ranges(keyed, ranges, "_ranges", config).withColumn("_cut", cut_ranges(config)(of, "_ranges"))
    keys = ranges.select("_key").distinct()
    rest = keyed.join(broadcast_if_small(keys, keys.count(), config.broadcast_rows), "_key", "left_anti")
    n = F.length(of).cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    hit = hit.select(*own.back(), F.struct(n, F.col("_cut.n_removed"), F.col("_cut.n_spans"), F.col("_cut.kept")).alias(to))
    return hit.unionAll(rest.select(*own.back(), F.struct(n, zero.alias("n_removed"), zero.alias("n_spans"), of.alias("kept")).alias(to)))
