"""Alignment of two tokenizers against a plain form that encodes whole texts and makes every link."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from policyspark.llm import alignment, queries

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    if not os.path.exists(alignment.BYTES_A):
        pytest.skip("no vocabulary files")
    return alignment.load()


def plain(files, texts):
    """A row a text: tokens, groups, links, best links, sum of counts, checksum. Whole texts, every pair compared."""
    e = alignment.Encoders(*files)
    rows, held = [], defaultdict(int)
    for text in texts:
        a = e.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = e.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(e.a_bytes[x] for x in a) != raw or b"".join(e.b_bytes[x] for x in b) != raw:
            rows.append(([], [], [], []))
            continue
        spans = []
        for ids, size in ((a, e.a_bytes), (b, e.b_bytes)):
            at, mine = 0, []
            for x in ids:
                mine.append((at, at + len(size[x]), x))
                at += len(size[x])
            spans.append(mine)
        cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        parts = [[[x for s, t, x in side if lo <= s and t <= hi] for side in spans] for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(raw) < 3000 else None
        j, links = 0, []
        for s, t, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < t:
                links.append((x, spans[1][k][2]))
                k += 1
        if parts is None:
            parts, i, j = [], 0, 0
            for c in cuts:
                i2, j2 = i, j
                while i2 < len(spans[0]) and spans[0][i2][1] <= c:
                    i2 += 1
                while j2 < len(spans[1]) and spans[1][j2][1] <= c:
                    j2 += 1
                parts.append([[x for _, _, x in spans[0][i:i2]], [x for _, _, x in spans[1][j:j2]]])
                i, j = i2, j2
        for p in set(links):
            held[p] += 1
        rows.append((a, b, parts, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, parts, links in rows:
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in parts)
        out.append((len(a), len(b), len(parts), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out


def test_words_encode_as_whole_texts_do(files):
    e = alignment.Encoders(*files)
    assert e.by_word
    rng = random.Random(2)
    letters = ["a", "b", "the", "'s", "'ll", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "é", "漢字", "9", "1234", ".", "!!", "<s>", "<0x41>", "<|endoftext|>", "　", "ﬁ", "x" * 30, "​", "👍🏽", "\0"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))
        words = e.split(text)
        assert "".join(words) == " " + text
        assert [x for w in words for x in e.a.encode(w, add_special_tokens=False).ids] == e.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [x for w in words for x in e.b.encode(w[1:])] == e.b.encode(text), text


def test_groups_end_where_both_end():
    a, b, ends = alignment.groups(alignment.np.array([2, 3, 1]), alignment.np.array([2, 4]))
    assert (a.tolist(), b.tolist(), ends.tolist()) == ([0, 1, 1], [0, 1], [2, 6])


@pytest.mark.parametrize("block", [8_000_000, 3_000])
def test_query_against_whole_texts(spark, files, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain(files, [r.text for r in rows]), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_cross_tokenizer_alignment(spark, TINY).collect()}
    assert got == want


def test_awkward_rows(spark, files):
    texts = [None, "", " ", "\n", "a ▁ b", "<|endoftext|> and <s>", "漢字 é " * 50, "the cat sat", "the cat sat", "word " * 20_000, "x" * 5_000, "  two  spaces ", "퟿\U0001f600"]
    frame = spark.createDataFrame([(None if i == 7 else i // 2, t, "k", [1], 3) for i, t in enumerate(texts)], "doc_id long, text string, block string, keys array<int>, n int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in alignment.aligned(frame, files).collect()), key=key)
    want = sorted(((None if i == 7 else i // 2, *w) for i, w in enumerate(plain(files, texts))), key=key)
    assert got == want and got[0][1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.aligned(frame.limit(0), files).count() == 0
