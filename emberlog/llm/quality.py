"""Quality rules: repetition by suffix arrays over words, beside a few counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ASCII_SPACE, Carried
from .tokens import forget
from .words import give_back

SYMBOLS = b"#*$%&|<>"
#: Words that one suffix array covers, unless a single text has more.
WORDS_A_BATCH = 200_000

MEASURES = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")])
SCHEMA = ", ".join(f"{f.name}: bigint" for f in MEASURES)


@dataclass(frozen=True)
class QualityRules:
    """Limits. A repeat is a run of at least min_repeat words that occurs twice or more in the text."""

    min_words: int = 50
    max_repeat_words_percent: int = 50
    min_repeat: int = 6
    max_covered_percent: int = 50
    max_longest_repeat: int = 200


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the longest run starting there that also starts at another position of the same text.

    words: numbers of words, texts one after another; equal words of different texts have different numbers. ends: where the
    text of each position ends. Suffixes are ranked by prefix doubling, in which only those that still tie go on; ranks of each
    level then give the longest common prefix of neighbours in suffix order, that is the deepest interval that holds a suffix.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    new = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    sizes = np.repeat(np.diff(np.append(starts, n)), np.diff(np.append(starts, n)))
    active = order[sizes > 1]
    levels, step = [rank.astype(np.int32 if n < 2**31 else np.int64)], 1
    while len(active):
        follow = active + step
        second = np.where(follow < ends[active], rank[np.minimum(follow, n - 1)], -1)
        by = np.argsort(rank[active] * (n + 1) + second + 1, kind="stable")
        active, second = active[by], second[by]
        first = rank[active]
        group = np.concatenate(([True], first[1:] != first[:-1]))
        split = group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        split_at = np.maximum.accumulate(np.where(split, at, 0))
        rank = rank.copy()
        rank[active] = first + split_at - group_at
        starts = np.flatnonzero(split)
        sizes = np.repeat(np.diff(np.append(starts, len(active))), np.diff(np.append(starts, len(active))))
        active = active[sizes > 1]
        step *= 2
        levels.append(rank.astype(levels[0].dtype))
    suffixes = np.argsort(rank, kind="stable")
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        got += same * (1 << k)
    common[live] = got
    longest = np.zeros(n, np.int64)
    longest[suffixes[:-1]] = common
    longest[suffixes[1:]] = np.maximum(longest[suffixes[1:]], common)
    return longest


def covered(longest: np.ndarray, least: int, reach: int | None, n: int) -> np.ndarray:
    """Positions in the union of repeats of at least `least`; with reach, of the windows of so many words."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (reach or longest[at]), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    """The measures of each text, from one suffix array over all of them."""
    number: dict[bytes, int] = {}
    out = {f.name: np.zeros(len(texts), np.int64) for f in MEASURES}
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        lengths[i] = len(words)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        out["word_chars"][i] = len(text or "") - (len(raw) - len(raw.translate(None, ASCII_SPACE)))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line.strip(ASCII_SPACE)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    out["n_words"] = lengths
    starts = np.concatenate(([0], np.cumsum(lengths)))
    of = np.repeat(np.arange(len(texts)), lengths)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    longest = longest_repeats(of * max(1, len(number)) + words, starts[1:][of])
    for name, mask in (("n_repeat_words", covered(longest, 3, 3, len(words))), ("covered_words", covered(longest, min_repeat, None, len(words)))):
        out[name] = np.bincount(of[mask], minlength=len(texts))
    np.maximum.at(out["longest_repeat"], of, longest)
    return out


def quality_measures(text: Column, rules: QualityRules = QualityRules()) -> Column:
    """A struct column of MEASURES for a text."""
    least = rules.min_repeat

    @F.arrow_udf(f"struct<{SCHEMA}>")
    def measures(texts: pa.Array) -> pa.Array:
        forget()  # packing may have left its tokenizer here
        give_back()
        values, group, size, done = texts.to_pylist(), [], 0, []
        for i, value in enumerate(values):
            group.append(value)
            size += len(value or "")
            if size >= 6 * WORDS_A_BATCH or i == len(values) - 1:
                done.append(measure(group, least))
                group, size = [], 0
        return pa.StructArray.from_arrays([pa.array(np.concatenate([d[f.name] for d in done]) if done else [], pa.int64()) for f in MEASURES], fields=list(MEASURES))

    return measures(text)


def quality_rules(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules(), to: str = "quality") -> DataFrame:
    """Adds the struct column `to`: the measures, base_failed, and kept, the verdict of all rules.

    Words are runs without ASCII white space. Maximal repeated substrings of a text's words are the intervals of its suffix
    array's common prefixes; their spans are united. A text is rejected if it has too few words, too many words in repeated
    3-word windows, too large a part covered by repeats of min_repeat words or more, or too long a repeat.

    A null or empty text has no words and fails. A column of the name `to` is replaced; all others stay. Repeated rows are
    judged alike; an empty table stays empty. A very long text is one suffix array of its own, in one task.
    """
    own = Carried(docs, to)
    out = own.rows.withColumn("_q", quality_measures(F.col(own.at(text)), rules))
    n = F.col("_q.n_words")
    failed = (n < rules.min_words) | (100 * F.col("_q.n_repeat_words") > rules.max_repeat_words_percent * n)
    bad = failed | (100 * F.col("_q.covered_words") > rules.max_covered_percent * n) | (F.col("_q.longest_repeat") > rules.max_longest_repeat)
    return out.select(*own.back(), F.col("_q").withField("base_failed", failed).withField("kept", ~bad).alias(to))
