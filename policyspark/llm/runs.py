"""Periodic runs of words: every maximal stretch that repeats itself at least three times, and texts without the repeats.

A stack of Lyndon words, scanned from right to left, gives each place the longest Lyndon word that
starts there; done under both orders of the words it holds a root of every run. Suffixes are
compared and roots extended by the length of their common extension: word by word at first, then
by binary search over rolling hashes. A run found is verified word by word. No suffix array is made.

Before the scan a text is cut where no run can be: all words of a run of `least` words or more and
period q lie in windows of least * (times - 1) / times words that occur again q words further on,
so stretches of windows that occur more than once are scanned, each as a text of its own. That
loses nothing: a run lies in one stretch whole, and where its stretch ends it can't go on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from policyspark.llm.common import SLICE, Words, typed

LEAST, TIMES = 24, 3  # a run has so many words at least, and so many periods
KNOWN = 500_000  # words numbered at once
DIRECT, NEAR = 8, 64  # words compared before hashes are; the longest period compared by its words alone
PRIME, BASE = (1 << 61) - 1, 1_000_003_000_037
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k numbers: equal windows have equal hashes."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * FACTOR
    h ^= h >> np.uint64(29)
    whole, width, done, power = None, 1, 0, FACTOR
    while True:  # windows of 1, 2, 4, ... numbers, put together to k
        if k & width:
            whole = h if whole is None else whole[: len(ids) - done - width + 1] * power + h[done : len(ids) - width + 1]
            done += width
        if done == k:
            return whole
        h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
        width, power = 2 * width, power * power


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs."""
    k = max(1, -(-least * (times - 1) // times))
    if len(ids) < least:
        return
    with np.errstate(over="ignore"):
        h = windows(ids, k)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        first = np.flatnonzero(twice[at] == h)
        cover = np.zeros(len(ids) + 1, np.int64)
        cover[first] += 1
        cover[first + k] -= 1
        inside = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(inside))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= least:
                yield start, end


def _scan(s: list[int], least: int, times: int, hashed: bool) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs whose root is a Lyndon word in the numbers' order."""
    n = len(s)
    sums = list(accumulate(s, lambda h, x: (h * BASE + x + 0x5BD1E995) % PRIME, initial=0)) if hashed else []
    powers = list(accumulate(range(n), lambda p, _: p * BASE % PRIME, initial=1)) if hashed else []

    def same(i: int, j: int, size: int) -> bool:
        p = powers[size]
        return (sums[i + size] - sums[i] * p - sums[j + size] + sums[j] * p) % PRIME == 0

    def right(i: int, j: int) -> int:
        """Words that the suffixes at i and j > i have in common at their starts."""
        k, stop = 0, n - j
        while k < stop and s[i + k] == s[j + k]:
            k += 1
            if hashed and k >= DIRECT:
                break
        else:
            return k
        step = DIRECT
        while k + step <= stop and same(i + k, j + k, step):
            k, step = k + step, 2 * step
        while step > 1:
            step //= 2
            if k + step <= stop and same(i + k, j + k, step):
                k += step
        return k

    def left(i: int, j: int, most: int) -> int:
        """Words before i that equal those before j > i, `most` at most."""
        k, stop = 0, min(i, most)
        while k < stop and s[i - 1 - k] == s[j - 1 - k]:
            k += 1
            if hashed and k >= DIRECT:
                break
        else:
            return k
        step = DIRECT
        while k + step <= stop and same(i - k - step, j - k - step, step):
            k, step = k + step, 2 * step
        while step > 1:
            step //= 2
            if k + step <= stop and same(i - k - step, j - k - step, step):
                k += step
        return k

    found = set()
    after = [n] * (n + 1)  # where the longest Lyndon word of each place ends: the next smaller suffix
    shared = [0] * (n + 1)  # how many words that suffix has in common with the place's own
    for i in range(n - 1, -1, -1):
        a, j, common = s[i], i + 1, 0
        while j < n:
            b = s[j]
            if a < b:
                j = after[j]
                continue
            common = 0
            if a > b:
                break
            p = j - i
            if p <= NEAR and after[j] == j + p and s[i:j] == s[j : j + p]:
                common = p + shared[j]  # one more period before one that was compared already
            else:
                common = right(i, j)
            if j + common < n and s[i + common] < s[j + common]:
                j = after[j]
                continue
            break
        after[i], shared[i] = j, common if j < n else 0
        p = j - i
        if j < n and common > 0 and common + 2 * p > least - 1 and common > (times - 2) * p:
            before = left(i, j, p)  # a root that starts a period later than another is left to that one
            length = before + p + common
            if before < p and length >= least and length >= times * p:
                found.add((i - before, length, p))
    return found


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of `least` words and `times` periods, ascending. times: 2 at least."""
    found: set[tuple[int, int, int]] = set()
    for start, end in stretches(ids, least, times):
        piece = ids[start:end]
        s = piece.tolist()
        here = _scan(s, least, times, True) | _scan([-x for x in s], least, times, True)
        if any(not _verified(piece, *run) for run in here):  # two different stretches of words have one hash: without hashes then
            here = _scan(s, least, times, False) | _scan([-x for x in s], least, times, False)
        found |= {(start + at, length, period) for at, length, period in here}
    return sorted(found, key=lambda r: (r[0], r[2]))


def _verified(piece: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether the words repeat with the period, and neither neighbour goes on with it."""
    end = start + length
    return bool(
        (piece[start : end - period] == piece[start + period : end]).all()
        and (start == 0 or piece[start - 1] != piece[start - 1 + period])
        and (end == len(piece) or piece[end] != piece[end - period])
    )


def planted(ids: np.ndarray, doc_id: object) -> np.ndarray:
    """The words with a periodic tail where the id's checksum says so: one id in ten. None has no checksum and no tail."""
    n, h = len(ids), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover)[:-1] == 0


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period, exactly; ties: the least start, then the least period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _words(names: list[bytes], ids: np.ndarray) -> Iterator[bytes]:
    """The words joined by one space, in parts."""
    for at in range(0, len(ids), 100_000):
        yield (b" " if at else b"") + b" ".join(map(names.__getitem__, ids[at : at + 100_000].tolist()))


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """A row a document: doc_id, runs (start, length, period of each), text: its words without repeated periods, joined by one space.

    Null and empty texts have no runs and an empty text. Repeated rows repeat, an empty table gives
    no rows, other columns are not read. A text is held whole, its words as numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, rows in _found(batches, least, times, plant):
            texts = [b"".join(_words(names, ids[stay])).decode("utf-8", "surrogatepass") for names, ids, _, stay in rows]
            listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for _, _, found, _ in rows]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(listed, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    each = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    return docs.select("doc_id", "text").mapInArrow(run, typed(docs, "doc_id", runs=T.ArrayType(each), text=T.StringType()))


def _found(batches: Iterator[pa.RecordBatch], least: int, times: int, plant: bool) -> Iterator[tuple[pa.Array, list[tuple[list[bytes], np.ndarray, list, np.ndarray]]]]:
    """The ids of some rows, and each row's words by number, numbers, runs and which words stay."""
    words = Words()
    for batch in batches:
        texts, doc_ids = batch.column(1).cast(pa.binary()), batch.column(0)
        rows, first, held = [], 0, 0
        for i in range(batch.num_rows):
            if len(words) > KNOWN:
                words = Words()
            raw = texts[i].as_py() or b""
            ids = words.numbers(raw)
            if plant:
                ids = planted(ids, doc_ids[i].as_py())
            found = runs(ids, least, times)
            rows.append((words.names, ids, found, kept(len(ids), found)))
            held += len(raw)
            if held > SLICE or i + 1 == batch.num_rows:
                yield doc_ids.slice(first, i + 1 - first), rows
                rows, first, held = [], i + 1, 0


DIGEST = {"n_runs": T.LongType(), "start": T.LongType(), "length": T.LongType(), "period": T.LongType(), "exponent_milli": T.LongType(), "runs_sha256": T.StringType(), "collapsed_sha256": T.StringType()}


def digests(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """A row a document, its words with planted tails: how many runs, the run of the most periods, checksums of all runs and of the words that stay.

    Null, empty and blank texts have no words: no runs, four nulls, checksums of nothing. Rows
    without an id have no planted tail. Repeated rows repeat, an empty table gives no rows, other
    columns are not read. exponent_milli is the floor of 1000 * length / period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, rows in _found(batches, least, times, True):
            made = []
            for names, ids, found, stay in rows:
                best, text = longest(found), hashlib.sha256()
                for part in _words(names, ids if stay.all() else ids[stay]):
                    text.update(part)
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
                made.append((len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), text.hexdigest()))
            columns = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*made, strict=True))]
            yield pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", *DIGEST])

    return docs.select("doc_id", "text").mapInArrow(run, typed(docs, "doc_id", **DIGEST))
