"""Source divergence against brute force, and the frequent-pattern tree against plain pairs of sources."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberlog.llm import divergence
from emberlog.llm.divergence import DivergenceConfig, PatternTree, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, min_docs, top=50):
    df, n, groups = Counter(), Counter(), defaultdict(set)
    for t, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = terms_of(t)
        for w in terms:
            n[lang, source, w] += 1
        for w in set(terms):
            df[lang, w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), k in df.items() if x == lang and k >= min_docs]

        def p(counts, kept=kept):
            total = sum(counts[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 1_000_000_000 * (counts[w] + 5) // total for w in kept}

        counts = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        ps = {s: p(c) for s, c in counts.items()}
        q = p({w: sum(c[w] for c in counts.values()) for w in kept})
        for s in sources:
            pair = [(sum(abs(ps[s][w] - ps[r][w]) for w in kept), r) for r in sources if r != s]
            term = [(ps[s][w] - q[w], w) for w in kept if counts[s][w] and ps[s][w] > q[w]]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(rows[:most], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(6)
    words = ["ka", "lo", "Mi", "Éte", "ñu", "日本", "ver", "Ton", "zed", "fu", "ab cd"]
    docs = []
    for k in range(400):
        lang = rng.choice(["en", "de", "fr", None])
        source = f"s{min(rng.randrange(9), rng.randrange(9))}"
        docs.append((" ".join(rng.choice(words[rng.randrange(4) :]) for _ in range(rng.randrange(30))), lang, source))
    docs += [(None, "en", "s1"), ("", "en", "quiet"), ("1 2 [] 3", "xx", "a"), (None, "xx", "b"), (None, None, None), ("long ver " * 60_000, "en", "s2")]
    docs += [("again ver ver", "de", "s3")] * 12 + [("only", "yy", "one")] * 12
    return docs


@pytest.mark.parametrize("paths", [16_384, 3])
def test_source_divergence(spark, monkeypatch, paths):
    docs = corpus()
    table = spark.createDataFrame([(i, *d, "t", 7) for i, d in enumerate(docs)], SCHEMA)
    config = DivergenceConfig(min_docs=8, top=4, broadcast_rows=100_000 if paths > 99 else 0)
    monkeypatch.setattr(divergence, "PATHS", paths)  # many small trees add up to one
    rows = source_divergence(table.repartition(5), config=config)
    assert dict(rows.dtypes)["rank"] == "int" and dict(rows.dtypes)["value"] == "bigint"
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in rows.collect()) == brute(docs, 8, 4)


def test_tree_shares_beginnings():
    rng = random.Random(1)
    rows = sorted(tuple(sorted({rng.randrange(6): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}.items())) for _ in range(400))
    times = Counter(rows)
    paths = sorted(times)
    zero = {s: 10 * s for s in range(6)}
    flat = [(s, p + zero[s], zero[s]) for path in paths for s, p in path]
    tree = PatternTree(np.cumsum([0, *map(len, paths)]), *(np.array(c, np.int64) for c in zip(*flat, strict=True)), np.array([times[p] for p in paths], np.int64))
    assert len(tree.source) == len({p[:k] for p in paths for k in range(1, len(p) + 1)})  # one node for each beginning
    want = Counter()
    for path in rows:
        for k, (s, p) in enumerate(path):
            for r, q in path[:k]:
                p_, q_ = p + zero[s], q + zero[r]
                want[s, r] += abs(p_ - q_) - abs(p_ - zero[r]) - abs(zero[s] - q_) + abs(zero[s] - zero[r])
    got = {(a, b): v for a, b, v in zip(*(x.tolist() for x in tree.corrections()), strict=True)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_counts_beyond_64_bits_of_product(spark):
    from pyspark.sql import functions as F

    n = 10**12
    row = spark.range(1).select(divergence.probability(F.lit(n), F.lit(3 * n + 1), F.lit(7), DivergenceConfig()).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (3 * n + 1 + 35)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
