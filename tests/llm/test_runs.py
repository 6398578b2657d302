"""Periodic runs against a search of every period at every place, and the query against a plain form of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from policyspark.llm import common, queries, runs

TINY = "/root/testdata/sf0.001"


def plain_runs(s, least=24, times=3):
    """Every (start, length, least period): all periods at all places."""
    found = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract of the query, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_against_every_period():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(0, 4) if n else 0):
            a, p, m = rng.randrange(n), rng.randrange(1, 9), rng.randrange(1, 60)
            s = s[:a] + (s[a : a + p] * 40)[:m] + s[a + m :]
        least, times = rng.choice([(24, 3), (6, 2), (4, 2), (9, 3), (1, 3)])
        assert runs.runs(np.array(s, np.int64), least, times) == plain_runs(s, least, times), (s, least, times)
        assert runs._scan(s, least, times, True) == runs._scan(s, least, times, False)


def test_long_texts_take_time_in_proportion():
    for s in ([0] * 60_000, [0, 1] * 30_000, list(range(700)) * 90):
        assert runs.runs(np.array(s)) == [(0, len(s), len(set(s)))]
    thue = np.array([bin(i).count("1") & 1 for i in range(1 << 15)])  # holds no run of three periods, and hashes modulo a power of two fail on it
    assert runs.runs(thue) == []


def test_a_hash_of_two_meanings_is_noticed(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(runs, "PRIME", 5)  # nearly all hashes are equal
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(20, 70))]
        s += s[-5:] * 8
        got = runs.runs(np.array(s))
        assert all(runs._verified(np.array(s), *r) for r in got)


def test_numbers_of_sliced_texts(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 7)
    text = "  one two\t\tthree one\x0b two threeandmuchmore one ".encode()
    words = common.Words()
    assert [words.names[i] for i in words.numbers(text)] == text.split()


def test_query_against_its_contract(spark):
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in rows}
    got = {r[0]: tuple(r) for r in queries.op12_periodic_runs(spark, TINY).collect()}
    assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 5


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 3_000), (None, "a b c " * 30), (5, "x y " * 12), (5, "x y " * 12), (6, "same"), (7, "\u00a0 é漢 " * 40), (8, "a " * 23), (9, "a " * 24)]
    return spark.createDataFrame([(i, t, "q", 7, [1]) for i, t in texts], "doc_id long, text string, start string, n_runs int, runs array<int>")


def test_awkward_rows(spark, odd):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got = sorted((tuple(r) for r in runs.digests(odd).collect()), key=key)
    assert got == sorted((plain_row(r.doc_id, r.text) for r in odd.collect()), key=key)
    assert runs.digests(odd.limit(0)).count() == 0 and runs.collapsed(odd.limit(0)).count() == 0


def test_texts_without_repeats(odd):
    found = {r.doc_id: r for r in runs.collapsed(odd).collect()}
    assert found[4].text == "word" and [tuple(x) for x in found[4].runs] == [(0, 3_000, 1)]
    assert found[None].text == "a b c" and found[5].text == "x y" and found[8].text == ("a " * 23).strip() and found[1].text == ""
