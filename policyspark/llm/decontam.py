"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark, weighted by their inverse document frequency over all
documents. A randomised SVD of the TF-IDF passages of what is indexed, which is all of the
benchmark, gives the latent space: each pass multiplies the passages' Gram matrix with a thin basis,
task by task. Every passage of every document is folded into the space, in
overlapping windows that hold any item of their length class whole, and those whose cosine and projection on an item are large enough become
candidates. A candidate is a leak if the longest common subsequence of item and passage covers
enough of the item; a paraphrase, with less, has to hold the item's answer (its last words) too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from policyspark.llm.common import checkpoint, give_back, plain_names

WORD = re.compile(r"\w+")
BLOCK = 16_384


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def places(ws: list[str]) -> dict[str, int]:
    """For each word the set of its places, as bits."""
    where: dict[str, int] = {}
    for i, w in enumerate(ws):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common_subsequence(n: int, where: dict[str, int], b: list[str]) -> int:
    """Length of the longest common subsequence of b and n words at those places, bit-parallel over the n."""
    v = full = (1 << n) - 1
    for m in filter(None, map(where.get, b)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Index:
    items: list
    words: list[list[str]]
    terms: dict[str, int]  # informative terms
    latent: np.ndarray  # term x k, weighted
    query: np.ndarray  # item x k
    cosine: float = 0.3
    projection: float = 0.4
    cover: float = 0.75
    paraphrase: float = 0.6

    def __post_init__(self) -> None:
        """Items by length: windows of one and a half times a power of two, half of it apart, hold any of a class whole."""
        self.norms, by = np.linalg.norm(self.query, axis=1), {}
        self.masks = [places(ws) for ws in self.words]
        own = [{self.terms[w] for w in ws if w in self.terms} for ws in self.words]
        self.terms_of = [sum(1 << t for t in ts) for ts in own]
        self.least = [max(1, len(ts) - int((1 - self.paraphrase) * len(ws))) for ts, ws in zip(own, self.words, strict=True)]
        for k, ws in enumerate(self.words):
            by.setdefault(max(4, (len(ws) - 1).bit_length()), []).append(k)
        self.spans = [(3 * 2**c // 2 + 2, 2 ** (c - 1), np.array(ks)) for c, ks in sorted(by.items())]
        self.reach = max(span for span, _, _ in self.spans)

    def candidates(self, found: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, cosine, first place, place after the last) of each passage near an item, of terms by place (-1: none)."""
        for first in range(0, len(found), BLOCK):  # blocks of places that overlap, so long texts need no more memory
            part = found[first : first + BLOCK + self.reach]
            at = np.flatnonzero(part >= 0)
            if not len(at):
                continue
            sums = np.zeros((len(at) + 1, self.query.shape[1]), np.float32)
            np.cumsum(self.latent[part[at]], axis=0, out=sums[1:])
            for span, stride, ks in self.spans:
                q, norms = self.query[ks], self.norms[ks]
                starts = np.arange(0, min(BLOCK, len(found) - first), stride)
                low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + span)
                live = high - low > 0
                starts = starts[live]
                x = sums[high[live]] - sums[low[live]]
                size = np.sqrt(np.einsum("ij,ij->i", x, x))
                big = np.flatnonzero(size >= self.projection * norms.min())
                if not len(big):
                    continue
                dots = x[big] @ q.T
                near = (dots >= self.cosine * size[big, None] * norms) & (dots >= self.projection * norms**2)
                r, k = np.nonzero(near)
                cos, begin = dots[r, k] / np.maximum(size[big[r]] * norms[k], 1e-9), first + starts[big[r]]
                yield from zip(ks[k].tolist(), cos.tolist(), begin.tolist(), (begin + span).tolist(), strict=True)

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float, bool, int]]]:
        """For each text (item id, cosine, share of the item found in order, answer found, first word) of each item that leaks, at its best passage."""
        out: list[list] = []
        block, size = [], 0
        for i, text in enumerate(texts):
            block.append(words(text))
            size += len(block[-1]) + self.reach
            if size >= BLOCK or i + 1 == len(texts):
                out += self._leaks(block)
                block, size = [], 0
        return out

    def _leaks(self, texts: list[list[str]]) -> list[list[tuple[int, float, float, bool, int]]]:
        get, gap, best = self.terms.get, np.full(self.reach, -1), [{} for _ in texts]
        # texts follow each other with a gap before each that no window spans
        found = np.concatenate([part for ws in texts for part in (gap, np.array([get(w, -1) for w in ws], np.int64))])
        offsets = np.cumsum([0] + [len(ws) + self.reach for ws in texts[:-1]]).tolist()
        held: dict[tuple[int, int], int] = {}
        for k, cos, a, b in self.candidates(found):
            mask = held.get((a, b))
            if mask is None:
                mask = 0
                for t in found[a:b].tolist():
                    if t >= 0:
                        mask |= 1 << t
                held[a, b] = mask
            if (mask & self.terms_of[k]).bit_count() < self.least[k]:
                continue  # too few of the item's terms for any common subsequence that is long enough
            d = bisect_right(offsets, a) - 1
            low, high = max(0, a - offsets[d] - self.reach), max(0, b - offsets[d] - self.reach)
            item, near = self.words[k], texts[d][low:high]
            n = len(item)
            share = common_subsequence(n, self.masks[k], near) / n
            if share < self.paraphrase:
                continue
            tail = item[-max(3, n // 4) :]
            answer = common_subsequence(len(tail), places(tail), near) >= 0.6 * len(tail)
            if (share >= self.cover or answer) and (share, cos, -low) > best[d].get(k, ((0.0,),))[0]:
                best[d][k] = ((share, cos, -low), answer)
        return [[(self.items[k], cos, share, answer, -a) for k, ((share, cos, a), answer) in sorted(found.items())] for found in best]


def frequencies(docs: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each term is, over all documents; how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        n = 0
        for batch in batches:
            for x in batch.column(0):
                n += 1
                for w in shared.value.intersection(words(x.as_py())):
                    counts[w] = counts.get(w, 0) + 1
        counts[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    found = dict(docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect())
    return found, found.pop("", 0)


def passages(docs: DataFrame, weights: dict[str, tuple[int, float]], span: int = 48) -> DataFrame:
    """Sparse TF-IDF rows (ids, values) of consecutive passages of docs that hold two terms at least."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for x in batch.column(0):
                ws = words(x.as_py())
                for a in range(0, len(ws), span):
                    row: dict[int, float] = {}
                    for w in ws[a : a + span]:
                        if t := shared.value.get(w):
                            row[t[0]] = row.get(t[0], 0.0) + t[1]
                    if len(row) > 1:
                        ids.append(list(row))
                        values.append(list(row.values()))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["ids", "values"])

    return docs.select("text").mapInArrow(run, "ids array<int>, values array<double>")


def gram(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the sparse rows of A: a partial product for each task, summed by blocks of terms."""
    shared, wide, block = rows.sparkSession.sparkContext.broadcast(basis), basis.shape[1], 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, out = shared.value, np.zeros(shared.value.shape)
        for batch in batches:
            for ids, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.array(values)
                v /= np.linalg.norm(v) or 1.0
                out[ids] += np.outer(v, v @ b[ids])
        starts = [a for a in range(0, len(out), block) if out[a : a + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([out[a : a + block].tobytes() for a in starts], pa.binary())], ["start", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("part"))
        return pa.table({"start": table.column("start")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(basis.shape)
    for a, part in rows.mapInArrow(run, "start long, part binary").groupBy("start").applyInArrow(add, "start long, part binary").collect():
        got = np.frombuffer(part).reshape(-1, wide)
        out[a : a + len(got)] = got
    return out


def randomised_svd(rows: DataFrame, terms: int, k: int, over: int = 8, passes: int = 2, seed: int = 0) -> np.ndarray:
    """The k leading right singular vectors of the rows, terms x k."""
    wide = min(terms, k + over)
    q = np.random.default_rng(seed).standard_normal((terms, wide))
    for _ in range(passes):
        q = np.linalg.qr(gram(rows, q))[0]
    values, turn = np.linalg.eigh(q.T @ gram(rows, q))
    return (q @ turn[:, ::-1])[:, : min(k, wide)]


def build(docs: DataFrame, items: list[tuple], k: int = 128, common: float = 0.1, **limits: float) -> Index | None:
    """The index of some items, or None if none has a word.

    Document frequencies cover all documents, and the space is fitted on the passages of all items.
    Terms in over `common` of the documents are left out, but for items that would have fewer than
    three terms then.
    """
    kept = [(i, ws) for i, text in items if (ws := words(text))]
    if not kept:
        return None
    df, n = frequencies(docs, sorted({w for _, ws in kept for w in ws}))
    plain = {w for _, ws in kept for w in ws if df.get(w, 0) > common * n}
    needed = {w for _, ws in kept for w in (ws if len(set(ws) - plain) < 3 else set(ws) - plain)}
    terms = {w: t for t, w in enumerate(sorted(needed))}
    idf = np.array([np.log((n + 1) / (df.get(w, 0) + 0.5)) + 0.01 for w in terms])
    weights = {w: (t, float(idf[t])) for w, t in terms.items()}
    spark = docs.sparkSession
    own = spark.createDataFrame([(" ".join(ws),) for _, ws in kept], "text string")
    rows = checkpoint(passages(own.coalesce(8), weights))
    v = randomised_svd(rows, len(terms), k)
    latent = (v * idf[:, None]).astype(np.float32)
    query = np.stack([latent[[terms[w] for w in ws if w in terms]].sum(axis=0) for _, ws in kept])
    return Index([i for i, _ in kept], [ws for _, ws in kept], terms, latent, query, **limits)


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few texts are held as Python's at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = 4000, **options: float) -> DataFrame:
    """A row per document and item that leaks into it: doc_id, item_id, cosine, cover, answer, first_word.

    The benchmark is a stated query set: `block` items at a time against all rows. Null and empty
    texts and items never leak; repeated rows of docs give their rows each, repeated items count once.
    """
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType, T.DoubleType(), T.DoubleType(), T.BooleanType(), T.IntegerType()]
    names = ["doc_id", "item_id", "cosine", "cover", "answer", "first_word"]
    schema, types = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]), [to_arrow_type(k) for k in kinds]
    given = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    parts = max(1, -(-given.count() // block))
    out = None
    for part in range(parts):
        items = [tuple(r) for r in given.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()]
        if (index := build(docs, items, **options)) is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *hit) for part in slices(batch) for doc, hits in zip(part.column(0).to_pylist(), shared.value.leaks(part.column(1).to_pylist()), strict=True) for hit in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, block: int = 4000, **options: float) -> DataFrame:
    """The rows of docs into which no item leaks, with their columns whatever their names; repeated rows each, null and empty texts always."""
    given = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    parts = max(1, -(-given.count() // block))
    schema = docs.schema
    for part in range(parts):
        items = [tuple(r) for r in given.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()]
        if (index := build(docs, items, **options)) is None:
            continue
        shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    kept = part.filter(pa.array([not hits for hits in shared.value.leaks(part.column(at).to_pylist())], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(kept.columns, schema.names)
            give_back()

        docs = plain_names(docs).mapInArrow(run, schema)
    return docs
