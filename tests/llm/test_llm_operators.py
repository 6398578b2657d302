"""The ten training-data operators on small tables: brute force, exact round trips, held-out accuracy, awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyspark.llm import common, decontam, fingerprints, langid, licenses, quality, queries, secret_scan, sentpiece, simhash, toxicity, warc

TINY = "/root/testdata/sf0.001"
# columns that the operators use themselves, given by the caller with other meanings
CLASH = "fp string, h string, kind string, label string, predicted string, score string, component_id string, x string, _h string, term string, value string"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, blank and very long texts, a null id, repeated rows, ties, extra columns."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (None, "a text without an id"), (5, "same words here"), (5, "same words here"), (6, "same words here"), (7, "x"), (8, "▁ é漢 !!"), (9, "Licensed under the Apache License, Version 2.0.")]
    rows = [(i, t, "en" if i != 7 else None, "s", len(t or ""), *["c"] * 11) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="module")
def empty(spark, awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = list(range(1200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bounded_sample_is_bounded_and_stable(spark, docs):
    once = [common.bounded_sample(docs, "doc_id", ["lang"], 5) for _ in range(2)]
    a, b = ({r.doc_id for r in x.collect()} for x in once)
    assert a == b and 0 < len(a) <= 5 * docs.select("lang").distinct().count()


# ---- 1 secrets


def test_secrets_found_and_noise_left(spark):
    forest = secret_scan.learn(secret_scan.labelled_findings(spark))
    rows = [(1, 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" it is'), (2, "see commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (3, 'password = "your_password_here_12345"'), (4, "call 4785380592391139 now"), (5, None), (6, ""), (1, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!')]
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {(r.doc_id, r.secret, r.occurrences) for r in secret_scan.scan(data, forest).collect()}
    assert found == {(1, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 1), (1, "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", 2)}
    clean = secret_scan.redact(data, forest)
    assert clean.columns == data.columns and clean.count() == len(rows)
    texts = [r.text for r in clean.collect()]
    assert sum("[SECRET]" in (t or "") for t in texts) == 2 and None in texts and "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in texts[1]


def test_forest_beats_chance_on_held_out_findings(spark):
    found = secret_scan.labelled_findings(spark, 1200)
    forest = secret_scan.learn(found.where("pmod(xxhash64(candidate), 4) <> 0"))
    held = found.where("pmod(xxhash64(candidate), 4) = 0").selectExpr(f"{secret_scan._features('struct(candidate, before, after, path)')} as f", "label").collect()

    def vote(tree, f):
        while not isinstance(tree, float):
            tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
        return tree

    right = sum((np.mean([vote(t, r.f) for t in forest]) >= 0.5) == bool(r.label) for r in held)
    assert right / len(held) > 0.95


def test_secrets_are_judged_at_each_place(spark):
    forest = secret_scan.learn(secret_scan.labelled_findings(spark))
    x, y = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "5f1d0c2b9a8e7d6c4b3a29180f7e6d5c4b3a2918"
    texts = [f'see commit {x} of é \U0001f600 then token = "{x}" it is', f'see commit {x}{y} then\ntoken = "{y}"', f"see commit {x} and checksum {x}", f'token = "{x}" and commit {x}', " ".join([f"see commit {y}"] * 300) + f' token = "{y}"']
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.secret): r.start for r in secret_scan.scan(data, forest).collect()}
    assert found == {(0, x): texts[0].index(f'"{x}') + 1, (1, y): texts[1].index(f'"{y}') + 1, (3, x): 9, (4, y): len(texts[4]) - 41}
    clean = {r.doc_id: r.text for r in secret_scan.redact(data, forest).collect()}
    assert clean[2] == texts[2] and x not in clean[0] and x not in clean[3] and y not in clean[1] + clean[4]


def test_places_against_a_plain_search(spark):
    """With a forest that takes all, each candidate starts where a plain search first finds it."""
    import re

    rng = random.Random(9)
    texts = ["".join(rng.choice(("ab1" * 6, "Zz9/" * 5, " ", "=", "é", '"', "\n", "token", "x" * 60, " : ")) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", secret_scan.scored("text", "''", [1.0], 0.5).alias("x")).collect()
    for r in got:
        expect = {}
        for m in re.finditer(secret_scan.CANDIDATE, texts[r.doc_id]):
            expect.setdefault(m[0], m.start())
        assert {x.candidate: x.start for x in r.x} == expect


def test_secrets_plan_is_native(spark, docs):
    plan = queries.QUERIES["op1_secret_scans"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- 2 languages


def test_automaton_knows_every_substring_and_no_other():
    text = [random.Random(2).randrange(3) for _ in range(60)]
    nexts = langid.automaton(text)
    known = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}

    def walks(s):
        state = 0
        for c in s:
            if c not in nexts[state]:
                return False
            state = nexts[state][c]
        return True

    assert all(map(walks, known))
    assert not any(walks(s) for s in {tuple(random.Random(i).randrange(3) for _ in range(9)) for i in range(300)} - known)


def plain_phrases(text, known):
    phrases, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        at, phrases = at + max(n, 1), phrases + 1
    return phrases


@pytest.mark.parametrize("table", [langid.TABLE, 0])
def test_phrases_against_a_plain_parse(monkeypatch, table):
    monkeypatch.setattr(langid, "TABLE", table)
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    samples = (("a", "the cat sat on the mat and the dog"), ("b", "der hund lag auf der matte und die katze"), ("c", long))
    parser = langid.Parser(samples)
    words = long.split()
    mixed = " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(("cat", "hund", "qq", "é")) for _ in range(900))
    texts = ["the dog sat and the cat lay on a mat qq", "", "1 2", long, long + " " + long, mixed, "a" * 1500, long[7:1200] + long]
    got = parser.phrases([langid._folded(t) for t in texts])
    for i, t in enumerate(texts):
        for k, (_, known) in enumerate(samples):
            assert got[i, k] == plain_phrases("".join(map(chr, langid._folded(t))), "".join(map(chr, langid._folded(known)))), (i, k)
    assert got[3, 2] == 1 and got[4, 2] == 3
    rates, some = parser.rates(texts)
    assert some.tolist() == [True, False, False, *[True] * 5] and rates[0, 0] < rates[0, 1]


def test_every_language_is_learned(spark):
    words = [["".join(chr(0x4E00 + 40 * k + (7 * w + j * j) % 40) for j in range(4)) for w in range(5)] for k in range(70)]
    rows = [(f"id{i}", " ".join(random.Random(i).choices(words[i % 70], k=20)), f"l{i % 70:02d}") for i in range(420)]
    docs = spark.createDataFrame(rows + [("x", "long " * 40_000, "l00"), ("y", None, "l01"), (None, "abc", "l02"), ("z", "1 2 3", "none")], "doc_id string, text string, lang string")
    samples = langid.learn(docs)
    assert len(samples) == 70 and max(len(t) for _, t in samples) < 30_000
    got = langid.identify(docs, samples).collect()
    assert len(got) == 424 and all(r.lang_pred == f"l{int(r.doc_id[2:]) % 70:02d}" for r in got if r.doc_id and r.doc_id.startswith("id"))


def test_languages_held_out(spark):
    r = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) / len(r) > 0.98


def test_languages_of_awkward_rows(awkward, empty):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(awkward, (("de", "und der die das"), ("en", "the and of word same text"))).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got and len(got) == 10  # a repeated row repeats
    assert {p for _, p, _ in ((r.doc_id, r.lang_pred, 0) for r in langid.identify(awkward, ()).collect())} == {"und"}
    assert langid.learn(empty) == () and langid.identify(empty, ()).count() == 0


# ---- 3 leaks


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence_against_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontam.common_subsequence(len(a), decontam.places(a), b) == brute_common(a, b)


def test_leaks_found_whole_and_paraphrased_and_clean_texts_left(spark, docs):
    bench = spark.read.parquet(f"{TINY}/benchmark.parquet")
    items, base = dict(bench.collect()), [r.text for r in docs.where("length(text) > 400").limit(30).collect()]
    own = [t for t in base if not any(x in t for x in items.values())]
    rng, rows, expect = random.Random(5), [], set()
    for n, (k, x) in enumerate(items.items()):
        t = own[n % len(own)]
        ws = [w if n % 2 or rng.random() > 0.12 else "changed" for w in x.split()]
        rows.append((1000 + n, t[: len(t) // 2] + " " + " ".join(ws) + " " + t[len(t) // 2 :]))
        expect.add((1000 + n, k))
    clean = [(2000 + n, t) for n, t in enumerate(own)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows + clean + [(1, None), (2, "")], "doc_id long, text string"), bench).collect()}
    assert len(expect & got) / len(expect) >= 0.95 and not {d for d, _ in got if d >= 2000}


def test_leaks_of_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (2, None), (3, ""), (None, "x y")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(awkward, bench).collect()} == {(5, 1), (6, 1)}
    kept = decontam.clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(awkward, bench.limit(0)).count() == 0


def test_singular_vectors_span_the_same_space(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 20))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rows = spark.createDataFrame([(list(range(20)), r.tolist()) for r in a], "ids array<int>, values array<double>")
    v, exact = decontam.randomised_svd(rows, 20, 4), np.linalg.svd(a)[2][:4].T
    assert np.allclose(v @ v.T, exact @ exact.T, atol=1e-6)


def test_space_is_of_no_sample(spark):
    """Before, it was fitted on 400 documents at most besides the items; against a decomposition of all items, weighted by all documents."""
    rng, names = np.random.default_rng(3), [f"w{i}" for i in range(24)]
    drawn = lambda n: [" ".join(rng.choice(names[4 * (i % 6) : 4 * (i % 6) + 8], 60)) for i in range(n)]
    texts, items = drawn(900), drawn(40)
    index = decontam.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), list(enumerate(items)), k=16, common=1.0)
    idf = np.log(901 / (np.array([sum(w in t.split() for t in texts) for w in sorted(names)]) + 0.5)) + 0.01
    parts = [ws[a : a + 48] for ws in map(str.split, items) for a in (0, 48)]
    a = np.array([[p.count(w) for w in sorted(names)] for p in parts if len(set(p)) > 1]) * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    got, exact = index.latent / idf[:, None], np.linalg.svd(a)[2][:16].T
    assert list(index.terms) == sorted(names) and np.allclose(got @ got.T, exact @ exact.T, atol=1e-5)


# ---- 4 licences


def test_licences(spark, docs, awkward, empty):
    model = licenses.learn(docs)
    rows = [(i, n) for i, (f, ns) in enumerate(licenses.NOTICES.items()) for n in ns] + [(100, o) for o in licenses.OTHERS] + [(101, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!"), (102, "word " * 500 + "Released under the MIT License. " + "word " * 500)]
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect():
        got[r.doc_id].add(r.family)
    assert all(f in got[i] for i, f in enumerate(licenses.NOTICES)) and not got[100] and got[101] == {"apache-2.0"} and got[102] == {"mit"}
    assert {r.doc_id for r in licenses.scan(awkward, model).collect()} == {9}
    assert licenses.scan(empty, model).count() == 0 and licenses.learn(empty).families


def test_licences_against_a_scan_without_shortcuts(spark, docs):
    """Every stretch through the model, none passed over; wrapped notices are one."""
    model = licenses.learn(docs)
    wrapped = "Some words.\n\n" + "\n".join(["Permission is hereby granted, free of", "charge, to any person obtaining a copy", "of this software and associated documentation files"]) + "\n\nOther words."
    texts = [wrapped, *[n for ns in licenses.NOTICES.values() for n in ns], *licenses.OTHERS, *[r.text for r in docs.limit(120).collect()]]
    slow = licenses.Model(model.families, model.index, model.weights, model.bias, model.temperature)
    slow.prepare()
    slow.need = -1.0
    for t in texts:
        assert licenses.notices_of(t, model, 0.5) == licenses.notices_of(t, slow, 0.5)
    assert [(k, f) for k, f, _, s in licenses.notices_of(wrapped, model, 0.5) if s >= 0.6] == [(2, "mit")]
    assert licenses.notices_of(None, model, 0.5) == licenses.notices_of(" \n ", model, 0.5) == []


# ---- 5 archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://a.example/x", "<p>é</p>"), (3, "https://www.b.example/?q=1#z", None), (4, None, ""), (5, "http://c.example", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (2, "http://a.example/x", "<p>é</p>"), (None, "http://n.example", "<p>é</p>"), (6, "http://l.example", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert [r.record_type for r in by[1]] == ["revisit"] and by[1][0].refers_to == 2 and [r.record_type for r in by[2]] == ["response"] * 2
    assert by[3][0].refers_to == 4 and by[4][0].payload_bytes == 0 and by[5][0].payload_bytes == 18 and by[6][0].payload_bytes == 300_000 and by[None][0].record_type == "response"
    keys = [(r.url_key, r.captured_at) for r in got]
    assert keys == sorted(keys)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_one_long_page_leaves_the_other_archives_alone(spark, tmp_path):
    plain = spark.range(2000, numPartitions=4).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), "id").alias("url"), F.repeat(F.lit("x"), F.when(F.col("id") == 5, 3_000_000).otherwise(F.col("id") % 50).cast("int")).alias("html"), F.lit("clash").alias("size"), F.lit(1).alias("sha"))
    pages = plain.where("page_id <> 7")  # a filter over computed columns
    warc.write(pages, str(tmp_path / "w"), per_file=4000, file_bytes=1 << 22)
    assert len(list((tmp_path / "w").glob("*.gz"))) <= 8
    got = {r.page_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {i: 3_000_000 if i == 5 else i % 50 for i in range(2000) if i != 7}


def test_loser_tree_merges_any_runs():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# ---- 6 toxicity


def test_segments_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 25)
        scores = [rng.choice((2.0, 1.0, 3.0)) if rng.random() < 0.4 else -0.7 for _ in range(n)]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.7)

        def maximal(a, b):  # Ruzzo and Tompa: best segment, then the same to its left and right
            if a >= b:
                return []
            best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (round(x[0], 9), -(x[2] - x[1]), -x[1]))
            return [] if best[0] <= 0 else maximal(a, best[1]) + [best[1:]] + maximal(best[2], b)

        assert sum(s for *_, s in got) == pytest.approx(sum(sum(scores[i:j]) for i, j in maximal(0, n)))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((sum(scores[i:j]) for i, j in maximal(0, n)), default=0))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.96
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == 11 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0))).count() == 0
    marked = toxicity.Model({"scum$": 6.0}, scale=0.01)
    assert [(r.doc_id, r.passage) for r in toxicity.toxic_passages(spark.createDataFrame([(1, "the scum scum there"), (2, None)], "doc_id long, text string"), marked).collect()] == [(1, "scum scum")]


# ---- 7 quality


def test_quality_held_out_and_awkward_rows(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = quality.score(awkward, model).collect()
    assert len(got) == 11 and {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality.score(empty, quality.learn(empty, labels.limit(0))).count() == 0


def test_ranking_orders_preferred_texts():
    good, bad = ["The quick brown fox jumps over the lazy dog number %d today." % i for i in range(40)], ["Der " * (20 + i) for i in range(10)]
    model = quality.fit([(quality.features(t), 1) for t in good] + [(quality.features(t), 0) for t in bad], 0.2)
    assert min(map(model.score, good)) >= quality.CUT > max(map(model.score, bad))


# ---- 8 near duplicates


def brute_components(rows, radius=2):
    fps = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, f"{fps[i]:016x}", min(ids[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("bucket", [2, 64])
@pytest.mark.parametrize("m", [5, 7])
def test_near_duplicates_against_all_pairs(spark, docs, awkward, bucket, m):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000 + r.doc_id if r.doc_id else None, r.text) for r in awkward.collect()]
    base = rows[0][1].split()
    rows += [(20_000 + i, " ".join(w if j != 7 * i % len(base) else "new" for j, w in enumerate(base))) for i in range(60)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), m=m, bucket=bucket).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows))


def test_fingerprints_by_definition():
    import xxhash

    text = "One two\tTHREE two\nthree É four  five"
    words = ["one", "two", "three", "two", "three", "É", "four", "five"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(6)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 6)
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(" ") == simhash.fingerprint(None) == 0


# ---- 9 pieces


@pytest.fixture(scope="module")
def pieces():
    return sentpiece.load()


def test_samples_follow_the_lattice_without_repeats():
    toy = ("<unk>", "<s>", "</s>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "ab", "▁a", "ba", "▁ab")
    v, n = sentpiece.vocabulary(toy, 1.0), 4000
    index = {p: i for i, p in enumerate(toy)}

    def cuts(s):
        return [[]] if not s else [[p, *r] for p in toy[259:] if s.startswith(p.replace("▁", " ")) for r in cuts(s[len(p) :])]

    every = cuts(" abab")
    weights = np.array([np.exp(sum(v.weight[index[p]] for p in c)) for c in every])
    weights /= weights.sum()
    keys = [tuple(index[p] for p in c) for c in every]
    got = sentpiece.sample(v, ["abab"] * n, list(range(n)), len(every) + 1)
    assert all(len({tuple(s[0].tolist()) for s in x}) == len(every) for x in got[:50])  # all of them, each once
    pairs = Counter((tuple(x[0][0].tolist()), tuple(x[1][0].tolist())) for x in got)
    first = Counter(a for (a, _), k in pairs.items() for _ in range(k))
    for i in np.argsort(-weights)[:4]:
        assert first[keys[i]] / n == pytest.approx(weights[i], abs=0.03)
        for j in np.argsort(-weights)[:4]:
            if i != j:
                assert pairs[keys[i], keys[j]] / n == pytest.approx(weights[i] * weights[j] / (1 - weights[i]), abs=0.03)
    three = sentpiece.sample(v, ["abab"] * n, list(range(n)), 3)
    assert np.mean([sum(1 / q for *_, q in x) for x in three]) == pytest.approx(len(every), rel=0.2)


def test_pieces_of_a_block_are_spelt_at_once_and_blocks_change_nothing(docs):
    """Before, each sample was decoded and spelled on its own; the same pieces whatever texts share a block."""
    v = sentpiece.vocabulary(sentpiece.load(), 1.0)
    texts = ["", "a", "é漢 \n▁ x", *(r.text or "" for r in docs.limit(40).collect())]
    whole = sentpiece.sample(v, texts, list(range(len(texts))), 2)
    alone = [sentpiece.sample(v, [t], [i], 2)[0] for i, t in enumerate(texts)]
    assert [[x[0].tolist() for x in a] for a in whole] == [[x[0].tolist() for x in a] for a in alone]
    flat = [x[0] for a in whole for x in a]
    given = [(" " + t).encode() if t else b"" for t, a in zip(texts, whole, strict=True) for _ in a]
    assert v.spelt(flat) == given and [v.decode(x.tolist()) for x in flat] == [t for t, a in zip(texts, whole, strict=True) for _ in a]



def test_pieces_round_trip(spark, docs, awkward, empty, pieces):
    for table in (docs, awkward):
        made = sentpiece.sampled(table, pieces, 3)
        assert made.where("not round_trip").count() == 0
        texts = {(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()}
        assert {(r.doc_id, r.text) for r in sentpiece.decoded(made, pieces).collect()} == texts
    assert sentpiece.sampled(empty, pieces).count() == 0
    one = {(r.doc_id, r.sample): r.ids for r in sentpiece.sampled(docs.repartition(3), pieces).collect()}
    assert one == {(r.doc_id, r.sample): r.ids for r in sentpiece.sampled(docs.coalesce(1), pieces).collect()}


# ---- 10 fingerprints


def test_document_fingerprints_against_a_plain_walk(spark, docs, awkward, empty):
    import hashlib

    table = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = sorted(((r.doc_id, r.text or "", r.h) for r in table.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    expect = Counter()
    for n, (i, t, _) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        other = t[: len(t) - half] + after[:half]
        a, b, c = (fingerprints.fingerprint(x) for x in (t, other, after))
        expect[i, len(t), hashlib.sha256(other.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)] += 1
    assert Counter(map(tuple, fingerprints.document_fingerprints(table).collect())) == expect
    assert fingerprints.document_fingerprints(empty).count() == 0
    assert fingerprints.document_fingerprints(awkward.where("doc_id = 4")).first().near_next == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(60)]
    near = [b ^ sum(1 << i for i in rng.sample(range(128), k)) for b in base for k in range(6)]
    hexed = lambda xs: spark.createDataFrame([(f"{x:032x}",) for x in sorted(set(xs))], "fingerprint string")
    got = {(r.query, r.found, r.distance) for r in fingerprints.within(hexed(base), hexed(near), 3).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in set(base) for b in set(near) if (a ^ b).bit_count() <= 3}


def test_searches_of_awkward_rows(spark, empty):
    rows = [("100", "a b c"), ("100", "a b c"), ("200", "a b c"), (None, "a b c"), ("x", "a b c"), ("7", "other words"), ("300", None), ("8", "")]
    made = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id string, text string").withColumn("fingerprint", F.lit("c")))
    got = Counter((r.doc_id, r.near_queries) for r in fingerprints.search_counts(made).collect())
    assert got == Counter([("100", 2), ("100", 2), ("200", 2), (None, 3), ("x", 3), ("7", 0), ("300", 0), ("8", 1)])
    assert fingerprints.search_counts(fingerprints.document_fingerprints(empty)).count() == 0
    assert fingerprints.within(made.limit(0), made).count() == 0


def test_lookups_with_hot_keys_against_plain_joins(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.choice((1, 1, 1, rng.randrange(50))), i) for i in range(3000)], "k long, i long").cache()
    side, many = spark.createDataFrame([(k, -k) for k in range(0, 50, 2)] + [(1, 7)], "k long, s long"), spark.createDataFrame([(k % 9, k) for k in range(40)], "k long, s long")
    hot = spark.createDataFrame([(1,), (4,)], "k long")
    for how in ("inner", "left"):
        assert Counter(map(tuple, common.lookup(rows, side, ["k"], hot, how).select("k", "i", "s").collect())) == Counter(map(tuple, rows.join(side, "k", how).select("k", "i", "s").collect()))
    assert Counter(map(tuple, common.meet(rows, many, ["k"], hot).select("k", "i", "s").collect())) == Counter(map(tuple, rows.join(many, "k").select("k", "i", "s").collect()))


def test_query_columns(spark):
    made = queries.op10_document_fingerprints(spark, TINY).collect()
    assert len(made) == len({r.doc_id for r in made}) and all(r.near_queries >= 0 for r in made)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in queries.op7_quality_classifier(spark, TINY).collect() if r.held_out)


def test_samples_are_the_same_alone_and_in_company(pieces):
    v, texts = sentpiece.vocabulary(pieces, 1.0), ["one common word", "", "zwölf 漢字 und mehr", "x" * 700, "one common word\n\n  two"]
    together = sentpiece.sample(v, texts, list(range(5)), 2)
    for i, t in enumerate(texts):
        (alone,) = sentpiece.sample(v, [t], [i], 2)
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in together[i]]
        assert all(v.decode(s[0].tolist()) == t for s in alone)
