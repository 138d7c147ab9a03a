"""The pipeline against a brute-force version of each stage, and operators on very long texts, null ids and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")
pipeline = pytest.importorskip("corpus_pipeline")

from emberlog.llm import decontamination, language, licenses, sharding, token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi ten ru sha ver on pa qui".split() for b in "ba do fi go zen st ru".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def covered(ws, n):
    count = Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    return len({k + d for k in range(len(ws) - n + 1) if count[tuple(ws[k : k + n])] > 1 for d in range(n)})


def good(text):
    ws = words(text)
    return len(ws) >= 50 and 100 * covered(ws, 3) <= 50 * len(ws) and 100 * covered(ws, 6) <= 50 * len(ws) and covered(ws, 201) == 0


def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def without_repeated_lines(docs):
    out, seen = {}, []
    for i in sorted(docs):
        kept = []
        for line in docs[i].split("\n"):
            ws = words(line)
            gone = bool(ws) and any(ws == v or len(ws) >= 5 and len(v) >= 5 and one_word_apart(ws, v) for v in seen)
            if ws:
                seen.append(ws)
            if not gone:
                kept.append(line)
        if len(kept) == len(docs[i].split("\n")) or "\n".join(kept).strip(" "):
            out[i] = "\n".join(kept)
    return out


def one_of_each(docs):
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in docs.items())}
    head = {i: i for i in docs}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in docs:
        for j in docs:
            both = grams[i] | grams[j]
            if i < j and (docs[i] == docs[j] or both and len(grams[i] & grams[j]) >= 0.8 * len(both) - 1e-9):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def tokens(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def holds(text, item):
    d, n = tokens(text), len(tokens(item))
    it = tokens(item)
    size = min(n, 13)
    need = size - (2 if n >= 13 else 1 if n >= 10 else 0)
    return any(sum(0 <= k + g < len(d) and d[k + g] == it[k] for k in range(q, q + size)) >= need for g in range(-n, len(d)) for q in range(n - size + 1))


def corpus():
    rng = random.Random(21)
    items = [prose(rng, 24), prose(rng, 11), prose(rng, 6)]
    boiler = [prose(rng, 9) for _ in range(3)]
    base = ["\n".join(prose(rng, rng.randint(8, 25)) for _ in range(8)) for _ in range(12)]
    docs = []
    for k in range(60):
        t = base[rng.randrange(12)]
        kind = rng.randrange(7)
        if kind == 0:
            t = "\n".join(prose(rng, 14) for _ in range(6)) + "\n" + rng.choice(boiler)
        elif kind == 1:
            lines = t.split("\n")
            t = "\n".join(" ".join(w if rng.random() > 0.06 else rng.choice(WORDS) for w in x.split()) for x in lines)
        elif kind == 2:
            lines = ["\n".join(prose(rng, 15) for _ in range(5)), rng.choice(items)]
            swap = lines[1].split()
            swap[rng.randrange(len(swap))] = "other"
            t = lines[0] + "\n" + (" ".join(swap) if rng.random() < 0.5 else lines[1].upper()) + " " + prose(rng, 3)
        elif kind == 3:
            t = prose(rng, rng.choice([10, 49, 50, 51]))
        elif kind == 4:
            t = (prose(rng, 12) + " ") * 9
        elif kind == 5:
            t = prose(rng, 230)
            t = t + " " + t if rng.random() < 0.3 else t
        docs.append(t)
    return docs, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts, items = corpus()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {i: t for i, t in enumerate(texts) if good(t)}
    steps = [want]
    for step in (without_repeated_lines, one_of_each, lambda d: {i: t for i, t in d.items() if not any(holds(t, x) for x in items)}):
        want = step(want)
        steps.append(want)
    assert len({len(s) for s in steps}) >= 3 and 5 < len(want) < 50
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), expected in zip(pipeline.STAGES, steps):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_pipeline_of_null_ids_and_of_no_documents(spark, tmp_path):
    rng = random.Random(22)
    a, b = prose(rng, 90), prose(rng, 90)
    for name, rows in (("null", [(None, a, "en", "s", 1), (None, b, None, None, None), (None, a, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0)]), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = pipeline.run(spark, folder).collect()
        assert len(out) == (3 if rows else 0) and all(r.doc_id is None for r in out)  # rows of equal id and text are one document


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(23)
    item = prose(rng, 20)
    long = prose(rng, 80_000) + " " + item + " released under the mit license. " + prose(rng, 80_000)
    docs = spark.createDataFrame([(1, long, "xx", "s", len(long)), (2, prose(rng, 30), "xx", "s", 1), (3, "другой язык " * 20, "yy", "s", 1)], SCHEMA)
    found = decontamination.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in found} == {1: "7", 2: "", 3: ""}
    scan = {r.doc_id: r.licenses for r in licenses.license_scan(docs).collect()}
    assert scan[1].n_words == 160_025 and [p.start for p in scan[1].places] == [80_021] and scan[2].labels == []
    model = language.fit_language(docs)
    assert {r.doc_id: r.language.lang for r in language.predict_language(docs, model).collect()} == {1: "xx", 2: "xx", 3: "yy"}
    counts = token_counts.length_histogram(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sum(r.n_docs for r in counts) == 3
    store = sharding.shard_documents(docs, 10_000_000)
    assert {r.doc_id: len(r.text) for r in store.read(store.version()).collect()}[1] == len(long)
    assert np.isfinite(scan[1].score)
