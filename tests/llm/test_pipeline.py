"""The pipeline's stages, each on what the one before kept."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from policyspark.llm import queries, shingles, simhash
from policyspark.llm.common import give_back

TINY = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept, tables = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, TINY).write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        tables.append({r.doc_id: r for r in kept.collect()})
        if i < 4:
            assert kept.columns == docs.columns
    quality, dedup, clean, redacted, pieces = tables
    assert {r.doc_id for r in queries.op7_quality_classifier(spark, TINY).where("predicted = 1").collect()} == set(quality)
    fps = {i: simhash.fingerprint(r.text) for i, r in dedup.items()}
    assert not [1 for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2] and set(dedup) < set(quality)
    leaked = {r.doc_id for r in queries.op3_benchmark_decontamination(spark, TINY).collect()}
    assert not leaked & set(clean) and set(dedup) - set(clean) <= leaked
    secrets = {r.doc_id: r.secret for r in queries.op1_secret_scans(spark, TINY).collect()}
    assert set(redacted) == set(clean) and all(s not in redacted[i].text for i, s in secrets.items() if i in redacted)
    assert set(pieces) == set(redacted)


def test_awkward_documents_pass(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A plain text of several words that says something.", "en", "s", 50), (3, "A plain text of several words that says something.", "en", "s", 50), (None, "Another plain text of words without any id at all.", "en", "s", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, TINY)
    assert {3} <= {r.doc_id for r in kept.collect()} <= {3, None}  # a row without an id goes by its quality alone
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), TINY).count() == 0


def jaccard(a, b):
    """Of five-word shingle sets, by definition."""
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / len(one | two)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz") for _ in range(rng.choice((3, 30, 90)))) for _ in range(25)]
    texts = list(base)
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(3))
            texts.append(" ".join(w))
    texts += [" ".join(texts[0].split()[:2] + ["same words in a long and very common passage of many texts"] + [f"own{i}", f"word{i}"]) for i in range(30)]
    texts = sorted(set(texts))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, TINY).collect()}
    assert kept == {group.index(g) for g in set(group)} and 25 < len(kept) < len(texts) - 20


def test_a_near_copy_of_many_bits_goes(spark):
    words = [f"w{i}" for i in range(120)]
    a, b = " ".join(words), " ".join("new" if i in (40, 80) else w for i, w in enumerate(words))
    assert jaccard(a, b) >= 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2
    docs = spark.createDataFrame([(1, a), (2, b), (3, "another text of other words")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, TINY).collect()} == {1, 3}


def test_rows_go_by_likeness_and_not_by_id(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (7, b), (7, c), (None, d), (None, d), (None, d + " more"), (9, b), (5, c + " more"), (8, e), (None, e), (3, a + " x y"), (None, a)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, TINY).collect()]
    ids = {(i, t[0]) for i, t in got}
    assert len(got) == 5 and ids == {(3, "a"), (7, "b"), (5, "c"), (None, "d"), (8, "e")}


def test_clashing_and_odd_columns_go_along(spark):
    """A docs table that has every name the stages use themselves, and names that need quoting."""
    import pyspark.sql.functions as F

    names = ["held_out", "score", "predicted", "_quality", "_node", "_row", "node", "row", "root", "_found", "best", "s", "item_id", "cosine", "ids", "sample", "_text", "label", "a b", "x.y", "select", "é`z"]
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names], F.struct(*[F.lit(i).alias(f"f{i}") for i in range(40)]).alias("deep"))
    kept = wide
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, TINY)
        assert kept.schema == wide.schema or [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in wide.schema]
    rows = kept.collect()
    assert rows and all(r["x.y"] == "x.y" and r["é`z"] == "é`z" and r["predicted"] == "predicted" for r in rows)
    assert corpus_pipeline.encode(spark, kept, TINY).count() >= len(rows)


def test_fingerprints_are_searched_first_and_links_checked(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(["new", *words[1:]]), " ".join(words).upper(), " ".join(f"x{i}" for i in range(300)), "", None]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").withColumn("node", shingles.node()).cache()
    nodes = {r.node: r.doc_id for r in docs.collect()}
    pairs = {frozenset((nodes[r.u], nodes[r.v])) for r in shingles._by_fingerprint(docs.select("node", "text")).collect()}
    near = {frozenset((a, b)) for a in range(4) for b in range(a) if (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() <= 2}
    assert frozenset((0, 2)) in pairs and pairs <= near
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.select("doc_id", "text"), TINY).collect()} == {0, 3, 4}


def test_a_text_of_many_pairs_travels_once(spark, monkeypatch):
    """What is stored while pairs are checked are ids: texts go straight to where they are compared."""
    stored, keep = [], shingles.checkpoint
    monkeypatch.setattr(shingles, "checkpoint", lambda df: stored.append(df.schema.simpleString()) or keep(df))
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), *(" ".join([*words, f"more{i}"]) for i in range(12))]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, TINY).collect()] == [0]
    assert stored and not any("string" in s or "array" in s for s in stored)


def test_counts_by_class_never_part_similar_sets():
    rng = random.Random(3)
    for size in (1, 40, 600, 5000, 90_000):
        one = [rng.getrandbits(63) for _ in range(size)]
        other = one[: size - size // 10] + [rng.getrandbits(63) for _ in range(size // 9)]
        a, b = (np.unique(np.array(x, np.int64)) for x in (one, other))
        x, y = (np.frombuffer(shingles.class_counts(m), np.uint8).astype(int) for m in (a, b))
        assert len(x) == shingles.CLASSES and np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_texts_that_counts_tell_apart_do_not_travel(spark, monkeypatch):
    """Long texts with a passage in common were sent and compared whole: sketches of 128 bits can't tell these apart."""
    sent, similar = [], shingles._similar
    monkeypatch.setattr(shingles, "_similar", lambda pairs, *rest: sent.append(pairs.count()) or similar(pairs, *rest))
    rng = random.Random(5)
    passage = " ".join(f"same{i}" for i in range(60))
    texts = [" ".join([passage, *(f"{i}w{rng.randrange(10**6)}" for _ in range(900))]) for i in range(6)]
    texts.append(texts[0] + " and a few more words")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, TINY).collect()) == list(range(6))
    assert sum(sent) <= 2


def test_workers_give_memory_back(spark):
    """Python workers kept what the largest batch had taken, in every stage after it."""

    def kept(batches):
        for batch in batches:
            held = [bytes(2000) + str(i).encode() for i in range(60_000)]
            size = lambda: next(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) // 1024
            most, table = size(), pa.array(held)
            keep = held[::1000]
            del held, table
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([most] * batch.num_rows), pa.array([size()] * batch.num_rows)], ["most", "left"])
            del keep

    row = spark.range(1).repartition(1).mapInArrow(kept, "most long, left long").first()
    assert row.left < row.most - 60
