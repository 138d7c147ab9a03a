"""Line dedup: a deletion-neighbourhood join over the words of lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Carried, row_key, written
from .words import Words, blocks, give_back, mixed, powers, signed, text_bytes


@dataclass(frozen=True)
class LineConfig:
    """Two lines are near if one word replaced, added or left out makes them equal, and both have min_words or more: in five
    words, one edit is a similarity of 0.8. Equal lines need no edit, so they may have any number of words."""

    min_words: int = 5


#: Odd bases of the two polynomial hashes over words.
BASES = (0x100000001B3, 0xD6E8FEB86659FD93)
EXACT, REPLACED, SHORTER, LONGER, REPEATED, HALF, HOT, DONE = range(8)


def keyed(hashes: np.ndarray, n_words: np.ndarray, kind: int, position: np.ndarray | int = 0) -> np.ndarray:
    """Keys of different kinds, lengths and positions differ."""
    salt = np.uint64(kind) + (np.asarray(n_words).astype(np.uint64) << np.uint64(3)) + (np.asarray(position).astype(np.uint64) << np.uint64(34))
    return mixed(hashes + mixed(salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))


class Lines:
    """The lines with a word of some texts, with hashes of any run of a line's words.

    of: the text of a line; at: its number there. A run's hash is the sum of word number times base^place, from place 0 on.
    """

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        new = np.flatnonzero(np.concatenate(([True], (words.text[1:] != words.text[:-1]) | (words.line[1:] != words.line[:-1])))) if len(words.line) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(words.line)))
        self.start, self.n = new, n
        self.end = self.start + self.n
        self.of, self.at = words.text[self.start], words.line[self.start]
        place = np.arange(len(words.line)) - np.repeat(new, n)
        top = int(n.max(initial=0)) + 1
        self.back, self.sums = [], []
        for base in BASES:
            self.back.append(powers(pow(base, -1, 1 << 64), top))
            sums = np.zeros(len(words.line) + 1, np.uint64)
            np.cumsum(words.numbers * powers(base, top)[place], out=sums[1:])
            self.sums.append(sums)

    def run(self, which: int, line: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The hash of words lo..hi-1 of each line."""
        at = self.start[line]
        return (self.sums[which][at + hi] - self.sums[which][at + lo]) * self.back[which][lo]

    def whole(self, which: int, line: np.ndarray) -> np.ndarray:
        return self.run(which, line, np.zeros_like(line), self.n[line])

    def without(self, which: int, line: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The hash of each line with word i left out; what stands behind moves one place forward."""
        sums, at = self.sums[which], self.start[line]
        return (sums[at + i] - sums[at]) + (sums[self.end[line]] - sums[at + i + 1]) * self.back[which][1]

    def half_keys(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, lines): two of these lines within one edit share a key. The edit leaves alone the first or the last half, as
        the shorter line counts it, which is this one or has one word less."""
        keys, own = [], []
        for less in (0, 1):
            some = line if not less else line[self.n[line] % 2 == 0]  # else the half is the same
            half = (self.n[some] - less) // 2
            keys += [keyed(self.run(0, some, np.zeros_like(half), half), half, 5), keyed(self.run(0, some, self.n[some] - half, self.n[some]), half, 6)]
            own += [some, some]
        return np.concatenate(keys), np.concatenate(own)


def picked(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> pa.Array:
    return batch.column(name).take(pa.array(rows))


def firsts(*groups: np.ndarray) -> np.ndarray:
    """For rows in order: whether a row is the first with its values."""
    order = np.lexsort(groups[::-1])
    new = np.zeros(len(order), bool)
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    new[:1] = True
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def shared_halves(keys: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of a key that different lines here have, to be sent) for each row: of every key the first row and the first of another
    line go out, from which any line elsewhere sees that it isn't alone."""
    pair = firsts(keys, lines)
    at = np.flatnonzero(pair)
    order = at[np.argsort(keys[at], kind="stable")]
    head = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    sent = np.zeros(len(keys), bool)
    sent[order[np.arange(len(order)) - start < 2]] = True
    more = np.unique(keys[order[np.arange(len(order)) - start == 1]])
    return np.isin(keys, more), sent


def line_rows(rows: DataFrame, doc_id: str, text: str, config: LineConfig) -> DataFrame:
    """Rows (key, line, kind, _key, _doc, _at) of every line: its own hash as a key (EXACT) and those of its halves (HALF).

    In order of document, only the earliest of equal lines in a batch gets these; others have a row of the kind REPEATED. Lines
    that share a half with another one of their block have a row of the kind HOT, and only two of them send the half: however
    many lines of the corpus have a half, few rows of it meet. Of rows with equal _key only one is looked at in a batch: their
    lines are the same lines.
    """

    def emit(batches):
        for batch in batches:
            give_back()
            docs, keys, texts = batch.column(doc_id).cast(pa.int64()), batch.column("_key").to_pylist(), text_bytes(batch.column(text))
            row_keys = mixed(np.array(keys, np.int64).view(np.uint64))
            ids = docs.to_pylist()
            once = {k: i for i, k in enumerate(keys)}.values()
            order = sorted(once, key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
            seen: set[tuple[int, int]] = set()
            for block in blocks([len(t) for t in texts], order):
                lines, row = Lines([texts[i] for i in block]), np.array(block, np.int64)
                every = np.arange(len(lines.n))
                whole = keyed(lines.whole(0, every), lines.n, EXACT)
                new = np.zeros(len(every), bool)
                for k, pair in enumerate(zip(whole.tolist(), lines.whole(1, every).tolist(), strict=True)):
                    if pair not in seen:
                        seen.add(pair)
                        new[k] = True
                first, old = np.flatnonzero(new), np.flatnonzero(~new)
                halves, of_half = lines.half_keys(first[lines.n[first] >= config.min_words])
                shared, sent = shared_halves(halves, whole[of_half])
                hot = np.unique(of_half[shared])
                halves, of_half = halves[sent], of_half[sent]
                own = np.concatenate([old, first, of_half, hot])
                kinds = np.repeat(np.array([REPEATED, EXACT, HALF, HOT], np.int8), [len(old), len(first), len(of_half), len(hot)])
                at = row[lines.of[own]]
                alone = lambda some: mixed(whole[some] + lines.at[some].astype(np.uint64) + row_keys[row[lines.of[some]]])  # noqa: E731  keys that nothing meets
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate([alone(old), whole[first], halves, alone(hot)])), signed(whole[own]), pa.array(kinds), picked(batch, "_key", at), docs.take(pa.array(at)), pa.array(lines.at[own].astype(np.int32))],
                    names=["key", "line", "kind", "_key", "_doc", "_at"],
                )

    return rows.select("_key", doc_id, text).mapInArrow(emit, "key long, line long, kind byte, _key long, _doc long, _at int")


def resolved(key: np.ndarray, check: np.ndarray, kind: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines near an earlier one here, rows to be sent), for rows in order of their lines. Of a near line only those rows go out
    that are the first of their kind with a key, which later lines may need."""
    first = firsts(key, check, kind)
    other = np.select([kind == SHORTER, kind == LONGER], [LONGER, SHORTER], kind)
    order = np.lexsort((np.arange(len(key)), check, key))
    group = np.cumsum(np.concatenate(([False], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])))) if len(key) else order
    of = np.empty(len(key), np.int64)
    of[order] = group
    least = np.full((8, int(group[-1]) + 1 if len(key) else 0), np.iinfo(np.int64).max)
    np.minimum.at(least, (kind, of), line)
    near = np.unique(line[least[other, of] < line])
    return near, first | ~np.isin(line, near)


def variant_rows(rows: DataFrame, doc_id: str, text: str, config: LineConfig) -> DataFrame:
    """The hashed keys of variants of the lines in _hot: their rests with the place of the word left out (REPLACED),
    themselves (SHORTER), and their rests (LONGER). check is a second, independent hash of the same words. Lines near an earlier
    one of their block have a row of the kind DONE, see resolved()."""

    def emit(batches):
        for batch in batches:
            give_back()
            docs, texts, hot, keys = batch.column(doc_id).cast(pa.int64()), batch.column(text).cast(pa.binary()).to_pylist(), batch.column("_hot").to_pylist(), batch.column("_key").to_pylist()
            ids = docs.to_pylist()
            wanted, row, at = [], [], []
            once = {k: i for i, k in enumerate(keys)}.values()  # repeated rows are one document
            for i in sorted(once, key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i])):
                own = texts[i].split(b"\n")
                numbers = sorted(hot[i])
                wanted += [own[k] for k in numbers]
                row += [i] * len(numbers)
                at += numbers
            for block in blocks([len(w) for w in wanted], list(range(len(wanted)))):
                lines = Lines([wanted[i] for i in block])
                line = np.flatnonzero(lines.n >= config.min_words)
                n = lines.n[line]
                each = np.repeat(line, n)
                place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                rest, rest_check, n_rest = lines.without(0, each, place), lines.without(1, each, place), lines.n[each] - 1
                key = np.concatenate([keyed(rest, n_rest, REPLACED, place + 1), keyed(lines.whole(0, line), n, SHORTER), keyed(rest, n_rest, SHORTER)])
                check = np.concatenate([rest_check, lines.whole(1, line), rest_check])
                kinds = np.repeat(np.array([REPLACED, SHORTER, LONGER], np.int8), [len(each), len(line), len(each)])
                own = np.concatenate([each, line, each])
                order = np.argsort(own, kind="stable")
                key, check, kinds, own = key[order], check[order], kinds[order], own[order]
                near, sent = resolved(key, check, kinds, own)
                key, check, kinds, own = (np.concatenate([x[sent], y]) for x, y in ((key, lines.whole(0, near)), (check, near.astype(np.uint64)), (kinds, np.full(len(near), DONE, np.int8)), (own, near)))
                which = np.array(block, np.int64)[lines.of[own]]
                of = np.array(row, np.int64)[which]
                yield pa.RecordBatch.from_arrays([signed(key), signed(check), pa.array(kinds), picked(batch, "_key", of), docs.take(pa.array(of)), pa.array(np.array(at, np.int32)[which])], names=["key", "check", "kind", "_key", "_doc", "_at"])

    return rows.mapInArrow(emit, "key long, check long, kind byte, _key long, _doc long, _at int")


def removed_lines(rows: DataFrame, doc_id: str, text: str, config: LineConfig) -> DataFrame:
    """(_key, _exact, _near) of rows (_key, doc_id, text): the numbers of a row's lines that go, since an earlier line equals them
    or is near."""
    own, kind = F.struct("_doc", "_key", "_at"), F.col("kind")
    same = Window.partitionBy("key")
    first = line_rows(rows, doc_id, text, config).withColumn("_other", F.min("line").over(same) != F.max("line").over(same)).withColumn("_before", F.min(own).over(same) < own)
    first = first.withColumn("_gone", (kind == REPEATED) | ((kind == EXACT) & F.col("_before"))).filter(F.col("_gone") | (kind == HOT) | ((kind == HALF) & F.col("_other")))
    marks = written(first.groupBy("_key").agg(F.collect_set(F.when(F.col("_gone"), F.col("_at"))).alias("_exact"), F.collect_set(F.when(~F.col("_gone"), F.col("_at"))).alias("_half")), "line-marks")
    hot = marks.select("_key", F.array_except("_half", "_exact").alias("_hot")).filter(F.size("_hot") > 0)
    # All columns go along: so the rows are dealt as for the last join, and Spark deals them once.
    keys = variant_rows(rows.join(hot, "_key"), doc_id, text, config)
    group = Window.partitionBy("key", "check")
    least = lambda k: F.min(F.when(kind == k, own)).over(group)
    near = keys.withColumn("_replaced", least(REPLACED) < own).withColumn("_longer", least(LONGER) < own).withColumn("_shorter", least(SHORTER) < own)
    near = near.filter((kind == DONE) | ((kind == REPLACED) & F.col("_replaced")) | ((kind == SHORTER) & F.col("_longer")) | ((kind == LONGER) & F.col("_shorter")))
    near = near.groupBy("_key").agg(F.collect_set("_at").alias("_near"))
    none = F.array().cast("array<int>")
    return marks.select("_key", "_exact").join(near, "_key", "full").select("_key", F.coalesce("_exact", none).alias("_exact"), F.coalesce("_near", none).alias("_near"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without its lines of these numbers."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        give_back()
        out = []
        for t, own in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            away = set(own or ())
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in away) if away and t is not None else t)
        return pa.array(out, pa.string())

    return kept(text, gone)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: LineConfig = LineConfig(), to: str = "lines") -> DataFrame:
    """Takes out every line of which an earlier line, in order of doc_id and line, is equal or near; adds the struct column `to`:
    n_lines, n_exact, n_near (lines taken out).

    Lines are split at \\n, words at ASCII white space; near means that one word replaced, added or left out makes lines of at
    least min_words equal. Whether an earlier near line itself goes doesn't matter. For such lines that share a half with another
    line, all variants with a word left out go out as hashed keys: lines of one length meet in (place, rest), lines of
    neighbouring lengths in the shorter one's own hash. Equal keys of those kinds are edit distance 1 by what they hold; a
    second hash, of other base, has to be equal too. Of equal or near lines in a batch only the earliest is shuffled with its
    keys, so that a line with very many copies meets as few rows as there are batches.

    Null texts stay null. Rows with equal doc_id and text are one document: their lines are no copies of one another. Null
    doc_ids come first; ids are whole numbers, and a text that is none stops the run. Lines without a word stay. A document may end up with an empty text. A column of the name `to` is
    replaced; other columns stay, whatever their names. A very long text is one row in one task.
    """
    own = Carried(docs, to)
    of = F.col(own.at(text))
    rows = own.rows.withColumn("_key", row_key(own.at(doc_id), own.at(text)))
    out = rows.join(removed_lines(rows, own.at(doc_id), own.at(text), config), "_key", "left")
    whole = F.coalesce(of, F.lit(""))
    counts = F.struct(
        (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_exact"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.size("_near"), F.lit(0)).cast("long").alias("n_near"),
    )
    kept = F.when(F.col("_exact").isNull(), of).otherwise(without_lines(of, F.array_union("_exact", "_near")))
    return out.select(*own.back(**{own.at(text): kept}), counts.alias(to))
