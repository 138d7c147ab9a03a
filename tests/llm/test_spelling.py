"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm.spelling import PositionIndex, SpellingConfig, code_points, search, spelling_variants

SCHEMA = "doc_id long, text string, word string, n int, form int"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least=5, every=97):
    counts = Counter()
    for i, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def got(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in rows)


def corpus():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (5, 5, 6, 6, 7, 8, 11, 12)]
    docs = []
    for k in range(150):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(base)
            for _ in range(min(rng.randrange(4), rng.randrange(4))):
                at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("abcéX")) + w[at + (kind != 1) :]
            words.append(w)
        docs.append((k, rng.choice([" ", ", ", "\n", "-"]).join(words)))
    docs += [(None, "tails tails tails tailX ××××× ÀBCDE àbcde"), (None, None), (9000, ""), (9001, "ab-cd 12 _"), (9002, "long text " * 100_000)]
    docs += [(9100, "twice here twice"), (9100, "twice here twice"), (9200, "abcabc " * 4 + "abcabd " * 4 + "abcabe " * 4)]
    return docs


@pytest.mark.parametrize("size", [4096, 32])
def test_spelling_variants(spark, size):
    docs = corpus()
    table = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in docs], SCHEMA)
    rows = spelling_variants(table, config=SpellingConfig(slice=size, broadcast_rows=1_000_000 if size > 99 else 0)).collect()
    want = brute(docs)
    assert got(rows) == want and len(want) > 150
    assert sum(w[4] > 20 for w in want) > 5  # blocks of many near words


def test_damage_and_small_words(spark):
    docs = corpus()[:40]
    table = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in docs], SCHEMA)
    assert got(spelling_variants(table, config=SpellingConfig(min_chars=3, every=5)).collect()) == brute(docs, 3, 5)
    assert got(spelling_variants(table, config=SpellingConfig(every=None)).collect()) == brute(docs, 5, None)


def test_position_index():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([6, 7]))) for _ in range(700)})
    counts = np.array([rng.randrange(3, 9) for _ in words])
    index = PositionIndex(words, counts, 6)
    assert index.words == [w for _, w in sorted(zip(-counts, words, strict=True))]
    found = {}
    for half in (0, 1):
        for w, n, best, n_best in search(index, words, 6, half):
            a = found.setdefault(w, [0, (0, "")])
            a[0] += n
            a[1] = min(a[1], (-n_best, best))
    of = dict(zip(words, counts.tolist(), strict=True))
    for w in words:
        near = [v for v in words if one_edit(w, v) and {len(w), len(v)} != {7}]  # two words of 7 are another pair of lengths
        assert found.get(w, [0, (0, "")])[0] == len(near)
        if near:
            assert found[w][1] == min((-of[v], v) for v in near)
    assert not index.near(code_points(["zzzzzz"], 6), 6, 3, False).any()  # letters that no word has


def test_no_words(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "only two words here", "", 1, 1)], SCHEMA)).count() == 0
