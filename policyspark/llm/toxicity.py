"""Toxic passages by maximum-scoring segment search.

Units are words and their beginnings of 4 to 8 letters. A unit's score is its log-odds ratio
between toxic and other labelled texts under an informative Dirichlet prior (the prior of a unit
follows its share of both); only units whose z-score is significant count, each by the number of
different contexts it was seen in, so copies of a text weigh as one. A word scores as its best
unit, any other word costs a little. The linear-time scan for all maximal scoring segments gives
the passages; their scores become expected counts of such segments in random text (Karlin and
Altschul's extreme-value law, decay and scale estimated on the other labelled texts), passages
of small expectation are significant, and what they exceed it by adds up to a document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from policyspark.llm.common import bounded_sample, checkpoint, fold, typed

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)


def units(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    cost: float = 0.15
    decay: float = 1.0
    scale: float = 1.0
    level: float = 0.05
    intercept: float = -3.0
    slope: float = 1.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        """Its best unit's score; 0 for no significant unit. Remembered for a bounded number of words."""
        found = max((self.scores.get(u, 0.0) for u in units(word)), default=0.0)
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = found
        return found

    def hits(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        words, known = WORDS.findall((text or "").lower()), self.known
        found = []
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = self.word(w)
            if s:
                found.append((i, s))
        return found, len(words)

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """(first word, last word, score, expectation) of every significant passage."""
        hits, n = self.hits(text)
        return self.significant(segments(hits, self.cost), n)

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        """Those of a text of n words whose expectation is small, with it."""
        rated = [(a, b, s, self.scale * max(n, 1) * math.exp(-self.decay * s)) for a, b, s in found]
        return [x for x in rated if x[3] <= self.level]

    def total(self, passages: list[tuple[int, int, float, float]]) -> float:
        return sum(math.log(self.level / max(e, 1e-300)) + 1 for *_, e in passages)

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * min(total, 60.0)))))


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which hits score and any other place costs."""
    found: list[list[float]] = []  # first, last, sum before, sum with; the nearest earlier one with a smaller sum before
    total, at = 0.0, 0
    for i, s in hits:
        total -= cost * (i - at)
        new = [i, i, total, total + s, -1]
        total, at = total + s, i + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            k = int(found[j][4])
            del found[j:]
            j = k
    return [(int(a), int(b), w - v) for a, b, v, w, _ in found]


def unit_scores(sample: DataFrame, prior: float = 500.0, z_min: float = 4.0, most: float = 6.0) -> dict[str, float]:
    """Scores of the significant units of sample (text, label); none unless both labels are there.

    A unit counts once for each pair of a word that starts with it and the word before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                pairs = set(zip(["", *words], words, strict=False))
                found = {(u, zlib.crc32(f"{before} {word}".encode())) for before, word in pairs for u in units(word)}
                if found:
                    names, marks = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([label] * len(found), pa.int32()), pa.array(marks, pa.int64())], ["unit", "label", "mark"])

    seen = sample.mapInArrow(run, "unit string, label int, mark long").distinct()
    counts = checkpoint(seen.groupBy("unit").agg(F.sum("label").cast("double").alias("toxic"), F.sum(1 - F.col("label")).cast("double").alias("other")))
    toxic, other, kinds = counts.agg(F.sum("toxic"), F.sum("other"), F.count("*")).first()
    if not toxic or not other:
        return {}
    # half a count besides the prior's share, else a unit of one label alone has no finite variance
    a = 0.5 + prior * (F.col("toxic") + F.col("other")) / (toxic + other)
    sides = [(F.col(c) + a, n + prior + kinds / 2 - F.col(c) - a) for c, n in (("toxic", toxic), ("other", other))]
    odds = F.log(sides[0][0] / sides[0][1]) - F.log(sides[1][0] / sides[1][1])
    spread = F.sqrt(1 / sides[0][0] + 1 / sides[1][0])
    chosen = counts.where("toxic >= 3").select("unit", odds.alias("odds"), (odds / spread).alias("z")).where((F.col("z") >= z_min) & (F.col("odds") > 1))
    return {unit: min(most, odds) for unit, odds, _ in chosen.collect()}


def fit(rows: list[tuple[int, int, list[float], list[float]]], scores: dict[str, float], model: Model | None = None) -> Model:
    """Calibrated on a row a text: label, words, the scores of its hits, the scores of its maximal segments.

    Without a scoring unit the model marks nothing.
    """
    if not scores:
        return Model()
    model = model or Model(scores)
    rows = sorted(rows)
    seen_scores = np.array([s for label, _, hits, _ in rows if not label for s in hits])
    words = max(1, sum(m for label, m, _, _ in rows if not label))
    rest = words - len(seen_scores)
    low, high = 1e-3, 5.0  # the decay: the positive root of E[exp(decay * score)] = 1
    for _ in range(60):
        mid = (low + high) / 2
        mean = (np.exp(mid * seen_scores).sum() + rest * math.exp(-mid * model.cost)) / words
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.decay = low
    tops = [(max(found, default=0.0), m) for label, m, _, found in rows if not label]
    model.scale = max(1e-6, float(np.mean([math.exp(min(50.0, model.decay * s)) / max(m, 1) for s, m in tops if s > 0] or [1e-3])) * max(1, sum(s > 0 for s, _ in tops)) / max(1, len(tops)))
    x = np.array([min(60.0, model.total(model.significant([(0, 0, s) for s in found], m))) for _, m, _, found in rows])
    y = np.array([label for label, *_ in rows], float)
    beta = np.array([-2.0, 0.5])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(30):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + 0.1 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.intercept, model.slope = float(beta[0]), max(1e-6, float(beta[1]))
    return model


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(text, label) of the folds learned from: whole texts, those of per_class ids of each label at most, each once."""
    rows = labels.where((fold("doc_id", 5) != 0) & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    ids = bounded_sample(rows, "doc_id", ["label"], per_class)
    chosen = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return checkpoint(found.select("text", "label").distinct())


def traced(sample: DataFrame, scores: dict[str, float]) -> DataFrame:
    """What fit needs of each text of sample (text, label), made where the texts are."""
    shared = sample.sparkSession.sparkContext.broadcast(Model(scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            made = [m.hits(x.as_py()) for x in batch.column(0)]
            found = [[s for *_, s in segments(hits, m.cost)] for hits, _ in made]
            columns = [batch.column(1), pa.array([n for _, n in made], pa.int32()), pa.array([[s for _, s in hits] for hits, _ in made], pa.list_(pa.float64())), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "words", "hits", "segments"])

    return sample.select("text", "label").mapInArrow(run, "label int, words int, hits array<double>, segments array<double>")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> Model:
    """Fitted on the whole texts of per_class rows of each label at most; only scores reach the driver."""
    sample = labelled(docs, labels, "toxic", per_class)
    scores = unit_scores(sample)
    return fit([tuple(r) for r in traced(sample, scores).collect()] if scores else [], scores)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row, from its whole text.

    Null, empty and blank texts have no passage and the score of none. A null id is not held out.
    Repeated rows repeat, an empty table gives no rows, other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.passages(x.as_py()) for x in batch.column(2)]
            scores = [m.score(m.total(p)) for p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(p) for p in found], pa.int32())], ["doc_id", "held_out", "score", "predicted", "passages"])

    source = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return source.mapInArrow(run, typed(docs, "doc_id", held_out=T.BooleanType(), score=T.DoubleType(), predicted=T.IntegerType(), passages=T.IntegerType()))


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_word, last_word, score, expectation, passage (its words).

    Texts without one give no row; repeated rows give theirs each.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [kind, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := shared.value.passages(text):
                    words = WORDS.findall(text.lower())
                    rows += [(i, a, b, s, e, " ".join(words[a : b + 1])) for a, b, s, e in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "first_word", "last_word", "score", "expectation", "passage"])

    long, double = T.LongType(), T.DoubleType()
    return docs.select("doc_id", "text").mapInArrow(run, typed(docs, "doc_id", first_word=long, last_word=long, score=double, expectation=double, passage=T.StringType()))
