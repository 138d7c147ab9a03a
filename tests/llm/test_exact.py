"""Exact dedup against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.llm.exact import ExactConfig, exact_dedup, normalised

SCHEMA = "doc_id long, text string, copies string, _n int, kept int"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "c", 1, 2) for i, t in pairs], SCHEMA)


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def brute(pairs):
    """For each row in order: (keep_id, size), and the (id, code points) of the row that stays."""
    groups = {}
    for i, t in pairs:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {p: (min(g)[3], len(g), -min(g)[0]) for p, g in groups.items()}


def check(spark, pairs, config):
    rows = exact_dedup(table(spark, pairs), config=config)
    assert rows.columns == ["doc_id", "text", "_n", "kept", "copies"]
    want, kept = brute(pairs), {}
    got = rows.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, pairs))
    for r in got:
        keep, size, most = want[plain(r.text)]
        assert (r.copies.keep_id, r.copies.group_size) == (keep, size)
        if r.copies.kept:
            kept.setdefault(plain(r.text), []).append((r.doc_id, len(r.text or "")))
    assert kept == {p: [(keep, most)] for p, (keep, _, most) in want.items()}  # one row of each group, the right one


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_exact_dedup(spark, limit):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([3, 70, 200]))) for _ in range(30)]
    base += ["p" * 80 + x for x in ("a", "b", "c")]  # equal lengths and prefixes, other ends
    pairs = []
    for k in range(300):
        t = rng.choice(base)
        if rng.random() < 0.5:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice([" ", "\t\n", "\x0b", "\r\x0c"]) + t[at:]
        pairs.append((k, t))
    pairs += [(900, None), (901, ""), (902, " \n"), (903, " "), (904, "long " * 200_000), (905, "long" * 200_000)]
    pairs += [(None, "no id"), (None, "no id"), (None, "no  id"), (7000, "again"), (7000, "again"), (7000, "agai n"), (7001, "aga in"), (None, "with id"), (5, "with id")]
    check(spark, pairs, ExactConfig(prefix=64, broadcast_rows=limit))


def test_a_large_group_of_ties_keeps_one_row(spark):
    check(spark, [(1, "x y")] * 3000 + [(None, "z")] * 500 + [(2, "w")], ExactConfig())


def test_empty_table_and_digest(spark):
    assert exact_dedup(table(spark, [])).count() == 0
    row = spark.createDataFrame([(" é\x1cx y\t",)], "text string").select(F.sha2(normalised(F.col("text")), 256).alias("h")).first()
    assert row.h == hashlib.sha256("é\x1cx y".encode()).hexdigest()
