"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from emberlog.llm import decontamination, jaccard, language, licenses, lines, packing, quality, sharding, substrings, token_counts  # noqa: E402
from emberlog.llm.tokens import WordMemoTokenizer  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, quality string, lines int, licenses int"
WORDS = [a + b for a in "ka lo mi ten ru sha ver on".split() for b in "ba do fi go zen st".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators add."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "q", 1, 2) for i, t in zip(ids, texts, strict=True)], DOC)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(6)]
    near = []
    for t in base[:3]:
        for k in range(4):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            near.append(" ".join(w))
    return [None, "", " \n ", "one", *base, *near, base[0], base[0], prose(rng, 5000), "\n".join([prose(rng, 12)] * 9), "x " * 400]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


SPECIAL = ["hello world <|endoftext|> x", "<|endoftext|><|startoftext|>", "a<|endoftext|>b. <|ENDOFTEXT|> <|endof text|>", "Σ<|endoftext|>ΑΣ ΑΣ<|startoftext|>\n"]


def test_tokenizer_memo_equals_the_library():
    t, own = WordMemoTokenizer(public_tokenizers.path("word_bpe_49k.json")), library()
    for x in [*SPECIAL, "it's it's. DON'T! Straße İstanbul ΣΑΣ ΌΣΟΣ. éé. ﬁne x\x1cy à́ ÀÉ.. aaaaaaaaaaaa banana. q z ǅ. K Å", "a b c <|endoftext|> 12.5%", ""]:
        assert next(t.encode([x])) == np.asarray(own.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert 49407 in own.encode(SPECIAL[0], add_special_tokens=False).ids


def test_packing(spark, texts):
    path, own = public_tokenizers.path("word_bpe_49k.json"), library()
    texts = [*texts, *SPECIAL, "word " * 50_000]
    rows = packing.pack(table(spark, texts), path, window=64, pieces_a_task=20).collect()
    ids = [np.asarray([*own.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    want = {i: len(x) for i, x in enumerate(ids)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == want[r.doc_id]
    got = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, n in want.items():
        at = 0
        for s, k in sorted(got[i]):
            assert s == at
            at += k
        assert at == n
    for parts in seqs.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at <= 64
    assert packing.pack(table(spark, []), path).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    sequences, _ = packing.best_fit_decreasing(lengths, 64)
    rooms, want = [], []
    for n in lengths:
        fit = [(r, -i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            r = min(fit)[0]
            i = next(i for i, x in enumerate(rooms) if x == r)
        else:
            rooms.append(64)
            i = len(rooms) - 1
        rooms[i] -= n
        want.append(i)
    assert len(rooms) == max(sequences) + 1  # as many windows as a plain search opens


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [prose(rng, n) for n in (5, 6, 7, 8, 20)]
    docs = []
    for _ in range(40):
        own = []
        for _ in range(3):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(3)
                i = rng.randrange(len(w))
                if k == 0:
                    w[i] = rng.choice(WORDS)
                elif k == 1:
                    w.insert(i, rng.choice(WORDS))
                elif len(w) > 1:
                    del w[i]
            own.append(" ".join(w))
        docs.append("\n".join(own))
    docs += [None, "", "a b", "a b", "buy now cheap\n\nbuy  now cheap\nbuy now dear"]
    flat = [((i, k), x.split()) for i, d in enumerate(docs) for k, x in enumerate((d or "").split("\n")) if x.split()]
    gone = {p for n, (p, w) in enumerate(flat) if any(w == v or len(w) >= 5 and len(v) >= 5 and edit_one(w, v) for _, v in flat[:n])}
    out = {r.doc_id: r for r in lines.line_dedup(table(spark, docs), to="lines").collect()}
    assert len(out) == len(docs) and out[40].text is None
    for i, d in enumerate(docs):
        if d is not None:
            assert out[i].text == "\n".join(x for k, x in enumerate(d.split("\n")) if (i, k) not in gone)
    assert lines.line_dedup(table(spark, [])).count() == 0
    twice = table(spark, [base[4], base[4]], [7, 7])
    assert {r.text for r in lines.line_dedup(twice).collect()} == {base[4]}


def test_lines_of_repeated_rows_in_one_batch(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 12) for _ in range(3))
    docs = table(spark, [a, a, f"{b}\n{b}", f"{b}\n{b}", c, c, f"{a}\nend"], [7, 7, 8, 8, None, None, 9]).coalesce(1)
    out = collections.Counter((r.doc_id, r.text) for r in lines.line_dedup(docs).collect())
    assert out == {(7, a): 2, (8, b): 2, (None, c): 2, (9, "end"): 1}


@pytest.mark.parametrize("config", [jaccard.JaccardConfig(), jaccard.JaccardConfig(small_bucket=2, block=3)])
def test_jaccard(spark, texts, config):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    n = len(texts)
    linked = lambda i, j: (texts[i] or "") == (texts[j] or "") or bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    links = [[j for j in range(n) if j != i and linked(i, j)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
    out = {r.doc_id: r for r in jaccard.near_duplicates(table(spark, texts), config=config).collect()}
    assert [out[i].class_id for i in range(n)] == label
    assert [out[i].n_links for i in range(n)] == [len(x) for x in links]
    kept = {r.doc_id for r in jaccard.one_of_each_class(table(spark, texts), config=config).collect()}
    assert kept == set(label)


def test_one_of_each_class_with_null_and_repeated_ids(spark):
    rng = random.Random(13)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    rows = [(1, a), (2, a + " so"), (2, b), (2, b), (None, a + " no"), (None, c), (None, c), (5, d), (5, d + " so"), (None, e), (None, e + " so"), (3, f), (None, f)]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    out = collections.Counter((r.doc_id, r.text) for r in jaccard.one_of_each_class(docs).collect())
    sure = {(1, a): 1, (2, b): 2, (None, c): 2, (3, f): 1}
    assert all(out.pop(k) == n for k, n in sure.items())
    assert [sorted(t[: len(d)] for i, t in out if i == k) for k in (5, None)] == [[d], [e]] and set(out.values()) == {1}


def test_jaccard_of_no_rows(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def removed(raws, length):
    seen = collections.Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("config", [substrings.SubstringConfig(), substrings.SubstringConfig(length=40, spacings=(16, 4, 1), gram=4)])
def test_substrings(spark, texts, config):
    raws = [(t or "").encode() for t in texts]
    want = removed(raws, config.length)
    out = {r.doc_id: r.repeats for r in substrings.remove_repeats(table(spark, texts), config=config).collect()}
    for i, (raw, gone) in enumerate(zip(raws, want, strict=True)):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans) == (len(raw), sum(gone), spans)
        assert bytes(out[i].kept) == bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    assert substrings.remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("length", [200, 40])
def test_substrings_of_repeated_rows_beside_near_copies(spark, parts, length):
    """Repeated rows have one key; near copies differ from them every `length` bytes or so, so that much is left for the last round."""
    rng = random.Random(length)
    config = substrings.SubstringConfig() if length == 200 else substrings.SubstringConfig(length=40, spacings=(16, 4, 1), gram=4)
    rows = []
    for group in range(10):
        base = bytearray(prose(rng, 600)[:3000].encode())
        at, edited = 0, bytearray(base)
        while at < len(base):
            edited[at] = ord("#")
            at += rng.randint(length - 5, length + 12)
        key = None if group % 3 == 0 else group
        rows += [(key, base.decode()), (key, base.decode()), (100 + group, edited.decode()), (200 + group, base.decode()[1500:] + prose(rng, 30))]
    rng.shuffle(rows)
    raws = [t.encode() for _, t in rows]
    want = collections.Counter((i, t, sum(gone)) for (i, t), gone in zip(rows, removed(raws, length), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = substrings.remove_repeats(docs, config=config).collect()
    assert collections.Counter((r.doc_id, r.text, r.repeats.n_removed) for r in out) == want


def test_quality(spark, texts):
    out = {r.doc_id: r.quality for r in quality.quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        longest = max((next((m for m in range(len(w), 0, -1) if any(w[a : a + m] == w[b : b + m] and len(w[b : b + m]) == m for a in range(len(w)) for b in range(a + 1, len(w)))), 0)) if len(w) <= 12 else -1 for _ in (0,))
        assert (out[i].n_words, out[i].n_repeat_words) == (len(w), len(hit))
        if longest >= 0:
            assert out[i].longest_repeat == longest
    assert not out[0].kept and out[4].kept and not out[len(texts) - 1].kept
    assert quality.quality_rules(table(spark, [])).count() == 0


def test_licenses(spark):
    texts = [None, "", "Used under the MIT License. See apache license, version 2", "CC-BY-NC 4.0 and cc by nc sa license", "SPDX-License-Identifier: GPL-3.0-or-later", "nothing here", "Under the\nmit-license!"]
    out = [r.licenses for r in licenses.license_scan(table(spark, texts)).orderBy("doc_id").collect()]
    assert out[0].n_words == 0 and out[0].labels == []
    assert out[2].base_labels == ["apache-2", "mit"] and [p.start for p in out[2].places] == [1, 6]
    assert out[3].base_labels == ["cc-by-nc"] and "cc-by-nc-sa" in out[3].labels and "cc-by-4" not in out[3].labels
    assert "gpl-3" in out[4].labels and out[4].base_labels == [] and out[5].labels == []
    assert out[6].base_labels == ["mit"]
    assert len(licenses.rules()) >= 200
    assert licenses.license_scan(table(spark, [])).count() == 0


def test_license_gate_loses_nothing(spark):
    """Grants without the word license, and a text for each rule, against the SQL, which has no gate."""
    duckdb = pytest.importorskip("duckdb")
    from re import _parser  # expands a pattern into a text that it matches

    from emberlog.llm import oracles

    rng = random.Random(15)

    def example(parsed):
        out = ""
        for op, arg in parsed:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "BRANCH":
                out += example(rng.choice(arg[1]))
            elif kind == "SUBPATTERN":
                out += example(arg[3])
            elif kind == "MAX_REPEAT":
                out += "".join(example(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
            else:
                assert kind == "IN"
                of, value = rng.choice(arg)
                out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "7"}[str(of)](value)
        return out

    grants = ["Released under MIT", "available under BSD 3-clause", "distributed under the terms of the MPL 2.0", "published under CC0 1.0", "released\nunder ISC", "covered under the WTFPL", "provided under the terms of the CDDL"]
    samples = [example(_parser.parse(r.pattern)) for r in licenses.rules() for _ in range(4)]
    texts = [*grants, *samples, *licenses.BASE_PHRASES, "nothing here", None]
    out = licenses.license_scan(table(spark, texts)).orderBy("doc_id").collect()
    labels = [r.licenses.labels for r in out]
    assert ["mit" in labels[0], "bsd-3-clause" in labels[1], "mpl-2" in labels[2], "cc0-1" in labels[3], "isc" in labels[4], "wtfpl" in labels[5], "cddl-1" in labels[6]] == [True] * 7
    assert all(labels[:-2]) and labels[-2:] == [[], []]
    sql = oracles.ORACLES["op6_license_scan"]
    assert "contains(" not in sql
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    want = {r[0]: r[6:8] for r in db.execute(sql).fetchall()}
    assert {r.doc_id: (",".join(r.licenses.labels), r.licenses.score) for r in out} == want


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, limit):
    rng = random.Random(8)
    items = [prose(rng, 30), prose(rng, 9), prose(rng, 4), None]
    swap = lambda t, at: " ".join("zzz" if i in at else w for i, w in enumerate(t.split()))
    filler = lambda: prose(rng, 60)
    texts = [None, "", filler(), filler() + " " + items[0].upper(), swap(items[0], {3, 12, 20}), swap(items[0], set(range(0, 30, 4))), items[1] + ".", swap(items[1], {4}), filler() + " " + items[2] + " " + filler(), " ".join(items[0].split()[5:18]), " ".join(items[2].split()[:3]), swap(items[2], {1})]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    config = decontamination.SeedConfig(broadcast_seeds=limit)
    out = [r.contaminated for r in decontamination.contamination(table(spark, texts), b, config=config).orderBy("doc_id").collect()]
    assert out == [False, False, False, True, True, False, True, False, True, True, False, False]
    assert [r.doc_id for r in decontamination.decontaminate(table(spark, texts), b, config=config).orderBy("doc_id").collect()] == [0, 1, 2, 5, 7, 10, 11]
    assert decontamination.contamination(table(spark, []), b, config=config).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(table(spark, texts), b.limit(0), config=config).collect())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination_by_items_with_null_and_repeated_ids(spark, limit):
    rng = random.Random(14)
    a, b, c, d = (prose(rng, n) for n in (20, 25, 30, 15))
    items = spark.createDataFrame([(None, a), (None, b), (None, a), (1, c), (1, d)], "item_id long, text string")
    texts = [prose(rng, 40), prose(rng, 9) + " " + a, f"{a} {b}", f"{c} and {a}", d, f"{d} {c}"]
    config = decontamination.SeedConfig(broadcast_seeds=limit)
    out = decontamination.contamination(table(spark, texts), items, config=config).orderBy("doc_id").collect()
    assert [(r.contaminated, r.n_items, r.item_ids) for r in out] == [(False, 0, ""), (True, 1, ""), (True, 2, ""), (True, 2, "1"), (True, 1, "1"), (True, 1, "1")]
    assert [r.doc_id for r in decontamination.decontaminate(table(spark, texts), items, config=config).collect()] == [0]


def test_language(spark):
    rng = random.Random(2)
    tongues = {"xx": "ka lo mi ten ru".split(), "yy": "sch ver ung keit zu".split(), "zz": "eau oi que ment ré".split()}
    say = lambda l, n: " ".join("".join(rng.choice(tongues[l]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(l, 60), l) for i, l in enumerate(rng.choice("xyz") * 2 for _ in range(240))] + [(900, None, "xx"), (901, "123 !!", "xx"), (902, say("yy", 40), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(df.filter("doc_id < 160 or doc_id > 800"))
    out = {r.doc_id: r.language for r in language.predict_language(df, model).collect()}
    right = [out[i].lang == l for i, _, l in rows[160:240]]
    assert sum(right) / len(right) >= 0.95 and out[902].lang == "yy"
    assert out[900].lang == out[901].lang == "und" and all(0 <= x.score <= 1 for x in out.values())
    none = language.fit_language(df.limit(0))
    assert {r.language.lang for r in language.predict_language(df, none).collect()} == {"und"}


def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    from emberlog.llm.tokens import byte_bpe

    lengths = [len(byte_bpe(path).encode_ordinary(t or "")) for t in texts]
    sums = token_counts.suffix_sums(token_counts.length_histogram(table(spark, texts), path), block=8).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.length) and r.n_docs_ge == sum(n >= r.length for n in lengths)
        assert r.n_tokens_ge == sum(n for n in lengths if n >= r.length) and r.n_tokens_cut == sum(min(n, r.length) for n in lengths)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 77, 500, 10**6)], "context_limit long")
    assert {r.context_limit: r.n_tokens_cut for r in token_counts.cut_totals(sums, limits).collect()} == {x: sum(min(n, x) for n in lengths) for x in (0, 1, 77, 500, 10**6)}
    assert token_counts.suffix_sums(token_counts.length_histogram(table(spark, []), path)).count() == 0


def test_sharding(spark, texts, tmp_path):
    docs = table(spark, texts * 3)
    store = sharding.shard_documents(docs, 4000, arrivals=5, folder=str(tmp_path / "s"), config=sharding.ShardConfig(target_bytes=40_000, small_bytes=1_000, fan_in=3))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert not store.plan(store.shards()) and store.version() > 5
    with pytest.raises(RuntimeError):
        store.commit(store.version() - 1, [], docs.schema)
    empty = sharding.shard_documents(table(spark, []), 10, arrivals=1, folder=str(tmp_path / "e"))
    assert empty.read().count() == 0


def test_pipeline_stages(spark, tmp_path, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    item = prose(rng, 25)
    docs = [prose(rng, 80) for _ in range(6)] + ["x " * 300]
    docs += [docs[0] + "\nshort", prose(rng, 60) + "\n" + item]
    table(spark, docs).select(*pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == list(pipeline.COLUMNS)
        kept.append({r.doc_id for r in d.select("doc_id").collect()})
    assert kept == [set(range(9)) - {6}, set(range(9)) - {6}, set(range(9)) - {6}, {0, 1, 2, 3, 4, 5, 7}]
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == kept[-1]
    assert d.filter(F.col("doc_id") == 7).first().text == "short"


CLASH = ("_key", "_text", "_doc", "_exact", "_near", "_ranges", "_cut", "_words", "_n", "_gone", "_node", "_item", "c0", "node", "key", "active")


def clashing(spark, texts, ids=None):
    """Documents with columns that are called as those inside operators are, and one with a dot."""
    ids = ids or list(range(len(texts)))
    names = ", ".join(f"`{c}` string" for c in (*CLASH, "a.b"))
    return spark.createDataFrame([(i, t, *(f"{i} {c}" for c in (*CLASH, "a.b"))) for i, t in zip(ids, texts, strict=True)], f"doc_id long, text string, {names}")


@pytest.mark.parametrize("operator", ["lines", "substrings", "licenses", "quality", "language", "jaccard", "decontamination"])
def test_other_columns_stay_whatever_their_names(spark, texts, operator):
    docs = clashing(spark, [*texts, "Released under MIT"])
    items = spark.createDataFrame([(1, texts[4])], "item_id long, text string")
    out = {
        "lines": lambda: lines.line_dedup(docs),
        "substrings": lambda: substrings.remove_repeats(docs),
        "licenses": lambda: licenses.license_scan(docs),
        "quality": lambda: quality.quality_rules(docs),
        "language": lambda: language.predict_language(docs, language.fit_language(docs.limit(0).withColumn("lang", F.lit("x")))),
        "jaccard": lambda: jaccard.one_of_each_class(docs),
        "decontamination": lambda: decontamination.decontaminate(docs, items),
    }[operator]()
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{r['doc_id']} {c}" for r in rows for c in (*CLASH, "a.b"))
    if operator in ("lines", "substrings", "licenses", "quality", "language"):
        assert len(rows) == len(texts) + 1


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_line_dedup_is_the_same_in_any_partitions(spark, parts):
    rng = random.Random(21)
    a, b = prose(rng, 12), prose(rng, 9)
    near = [a.replace(a.split()[k], f"nr{k}", 1) for k in range(8)]
    texts = [a, f"{b}\n{b}", *near, "hi there\nhi there", a, None, "", "hi there"]
    ids = [3, 4, *range(10, 18), 5, 3, 6, None, None]
    docs = table(spark, texts, ids)
    want = sorted(map(str, lines.line_dedup(docs.coalesce(1)).select("doc_id", "text", "lines").collect()))
    assert sorted(map(str, lines.line_dedup(docs.repartition(parts)).select("doc_id", "text", "lines").collect())) == want
    got = {(r.doc_id, r.text) for r in lines.line_dedup(docs).collect()}
    assert (3, a) in got and (4, b) in got and (10, "") in got and (17, "") in got and (5, "") in got and (None, "hi there") in got


def test_jaccard_recall_of_pairs_just_above_the_threshold(spark):
    rng = random.Random(31)
    docs, pairs = [], []
    for k in range(400):
        w = [f"{rng.choice(WORDS)}{rng.randrange(9)}" for _ in range(100)]
        v = list(w)
        for i in (10, 30):  # each change touches five of 96 shingles
            v[i] = f"new{k}"
        if k % 2:
            v.append("end")
        x, y = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (w, v))
        assert 0.8 <= len(x & y) / len(x | y) < 0.85
        pairs.append((2 * k, 2 * k + 1))
        docs += [" ".join(w), " ".join(v)]
    found = {r.doc_id: r.class_id for r in jaccard.near_duplicates(table(spark, docs)).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) / len(pairs) >= 0.95
    assert all(found[a] >= a - a % 2 for a in found)  # and no others are linked


def test_language_equals_dense_kernel_ridge(spark):
    """With every row a landmark, scores are those of one-versus-rest kernel ridge regression over sets of n-grams."""
    rng = random.Random(5)
    tongues = {"xx": "ka lo mi ten ru".split(), "yy": "sch ver ung keit zu".split()}
    say = lambda l: " ".join("".join(rng.choice(tongues[l]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
    rows = [(i, say(l), l) for i, l in enumerate(["xx", "yy"] * 25)]
    new = [(100 + i, say(l), l) for i, l in enumerate(["xx", "yy"] * 10)]
    config = language.LanguageConfig(buckets=1 << 18, landmarks=50, ridge=1e-2)
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), config=config)
    grams = lambda t: {t[i : i + n] for n in config.orders for i in range(len(t) - n + 1)}
    kernel = lambda a, b: np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])
    own, other = [grams(t) for _, t, _ in rows], [grams(t) for _, t, _ in new]
    y = np.array([[1.0, -1.0] if l == "xx" else [-1.0, 1.0] for _, _, l in rows])
    margin = config.softness * kernel(other, own) @ np.linalg.solve(kernel(own, own) + config.ridge * len(own) * np.eye(len(own)), y)
    want = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    out = {r.doc_id: r.language for r in language.predict_language(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    for (i, _, _), p in zip(new, want, strict=True):
        assert out[i].lang == ("xx" if p[0] > p[1] else "yy") and out[i].score == pytest.approx(p.max(), abs=0.01)
    assert language.predict_language(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_every_language_gets_landmarks(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} word{i % 30}", f"l{i % 30:02d}") for i in range(300)]
    config = language.LanguageConfig(landmarks=8, max_sample=90, buckets=1 << 10)
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), config=config)
    assert len(model.languages) == 30 and model.landmarks.shape[1] == 60


def test_more_languages_than_the_limit_are_refused(spark, texts):
    docs = table(spark, texts).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 5))
    with pytest.raises(ValueError, match="5 languages"):
        language.fit_language(docs, config=language.LanguageConfig(max_languages=4))
    assert len(language.fit_language(docs, config=language.LanguageConfig(max_languages=5)).languages) == 5


def test_length_quantiles(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    from emberlog.llm.tokens import byte_bpe

    lengths = sorted(len(byte_bpe(path).encode_ordinary(t or "")) for t in texts)
    sums = token_counts.suffix_sums(token_counts.length_histogram(table(spark, texts), path), block=8)
    q = spark.createDataFrame([(x,) for x in (0.1, 0.5, 0.9, 1.0)], "fraction double")
    out = {r.fraction: r.length for r in token_counts.length_quantiles(sums, q).collect()}
    assert out == {x: lengths[int(np.ceil(x * len(lengths))) - 1] for x in (0.1, 0.5, 0.9, 1.0)}


def test_shard_tiers_and_versions(spark, texts, tmp_path):
    config = sharding.ShardConfig(target_bytes=60_000, small_bytes=2_000, fan_in=3)
    store = sharding.ShardStore(spark, str(tmp_path / "t"), config)
    docs = table(spark, texts * 2)
    for k in range(7):
        store.append(docs.filter(F.pmod("doc_id", F.lit(7)) == k), 1)
        store.compact()
        assert not store.plan(store.shards())
    shards = store.shards()
    assert sum(s.n_rows for s in shards) == docs.count() == store.read().count() and len(shards) < 7
    early = store.read(2)
    n = early.count()
    store.vacuum(versions=store.version())
    assert early.count() == n  # its files are kept for readers of that version
    store.vacuum()
    assert store.read().count() == docs.count()
    tail = lambda path: path.rsplit("/data/", 1)[1]
    assert {tail(s.path) for s in store.shards()} == {tail(str(f)) for f in (tmp_path / "t" / "data").rglob("*.parquet")}


def test_null_ids_and_very_long_texts(spark):
    rng = random.Random(41)
    long = prose(rng, 60_000)
    docs = table(spark, [long, long, None, "one two", None], [None, 5, None, None, 7])
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sum(r.length for r in packing.pack(docs, path).collect() if r.start == 0) > 0
    assert {r.doc_id for r in packing.pack(docs, path).collect()} == {None, 5, 7}
    assert collections.Counter(r.doc_id for r in jaccard.near_duplicates(docs).collect()) == {None: 3, 5: 1, 7: 1}
    out = sorted(((r.doc_id or -1, r.repeats.n_bytes, r.repeats.n_removed) for r in substrings.remove_repeats(docs).collect()))
    n = len(long)
    assert out == [(-1, 0, 0), (-1, 7, 0), (-1, n, n), (5, n, n), (7, 0, 0)]
    assert sorted(len(r.text) if r.text is not None else -1 for r in lines.line_dedup(docs).collect()) == [-1, -1, 0, 7, n]
    assert sorted(r.quality.n_words for r in quality.quality_rules(docs).collect()) == [0, 0, 2, 60_000, 60_000]
