"""Language identification by cross-parsing entropy.

Labelled text of each language is turned into a suffix automaton. A document is parsed into
phrases, each the longest match of what follows in that language's text; the language that
needs the fewest wins, phrases being weighed by the logarithm of how much text was learned from
(matches grow with it), which makes them estimates of cross entropy.

All documents of a batch walk the automata in step: texts are cut into lanes of LANE symbols that
one lookup moves by a symbol together. A lane first starts as if a phrase began there; then each
lane is walked again from the state in which the lane before it really ended, as far as the two
walks differ, until no lane's start changes. The phrases are those of the whole text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policyspark.llm.common import bounded_sample, checkpoint, fold, typed

LANE, BUDGET, TABLE = 512, 2_000_000, 8_000_000  # symbols of a lane and of a block of texts, entries of a table of steps


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter."""
    found = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            found[c] = ord(s.lower()[0])
    return found


def _folded(text: str) -> np.ndarray:
    """Lower-case letters as code points; each run of others is one 0."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    return codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))] if len(codes) else codes


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Steps:
    """Transitions of a language's automaton over its own symbols, as (state << 1) | whether the symbol begins a phrase.

    A state is its number times `size`, so that state + symbol is a place of the table. A table of
    states by symbols is kept where that is small, else the automaton's own transitions sorted by
    place; both give the same steps. Symbols the language has not are the code size - 1.
    """

    def __init__(self, folded: np.ndarray):
        known = np.unique(folded)
        self.size = size = len(known) + 1
        self.codes = np.full(0x110000, len(known), np.int32)
        self.codes[known] = np.arange(len(known))
        nexts = automaton(self.codes[folded].tolist())
        dense = len(nexts) * size <= TABLE
        self.kind = np.int32 if dense else np.int64
        self.first = np.ones(size, self.kind)  # no match: the phrase ends, the symbol starts the next
        for c, to in nexts[0].items():
            self.first[c] = to * size << 1 | 1
        self.table = None
        if dense:
            self.table = np.tile(self.first, (len(nexts), 1))
            for state, row in enumerate(nexts):
                if state:
                    for c, to in row.items():
                        self.table[state, c] = to * size << 1
            self.table = self.table.ravel()
        else:
            moves = sorted((state * size + c, to * size << 1) for state, row in enumerate(nexts) if state for c, to in row.items())
            self.places, self.to = np.array([k for k, _ in moves], np.int64), np.array([t for _, t in moves], np.int64)

    def __call__(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(states + symbols)
        want = states + symbols
        at = np.minimum(np.searchsorted(self.places, want), len(self.places) - 1)
        return np.where(self.places.take(at) == want, self.to.take(at), self.first.take(symbols))


class Parser:
    """samples: (language, text) pairs, a language each."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in samples]
        folded = [_folded(text) for _, text in samples]
        self.steps = [Steps(one) for one in folded]
        self.weights = np.array([np.log2(len(one) + 2) for one in folded])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each whole text of symbols has in each language."""
        lengths = np.array([len(c) for c in texts], np.int64)
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        begins = np.zeros(len(owner), bool)
        begins[(np.cumsum(lanes) - lanes)[lanes > 0]] = True
        grid = np.zeros((len(owner), LANE), np.uint32)
        for c, n, at in zip(texts, lanes, np.cumsum(lanes) - lanes, strict=True):
            grid[at : at + n].reshape(-1)[: len(c)] = c
        ends = np.full(len(owner), LANE)
        ends[np.cumsum(lanes)[lanes > 0] - 1] = (lengths - (lanes - 1) * LANE)[lanes > 0]
        grid = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.names)))
        for k, steps in enumerate(self.steps):
            symbols = steps.codes.take(grid)
            moves, state = np.empty(grid.shape, steps.kind), np.zeros(grid.shape[1], steps.kind)
            for t in range(LANE):
                moves[t] = steps(state, symbols[t])
                state = moves[t] >> 1
            entry, last = np.zeros(grid.shape[1], steps.kind), moves[-1] >> 1
            while True:  # each round settles one more lane of every text at least
                before = np.where(begins, 0, np.roll(last, 1))
                lane = np.flatnonzero(before != entry)
                if not len(lane):
                    break
                entry[lane] = state = before[lane]
                for t in range(LANE):
                    moved = steps(state, symbols[t, lane])
                    apart = moved >> 1 != moves[t, lane] >> 1
                    moves[t, lane] = moved
                    lane, state = lane[apart], moved[apart] >> 1
                    if not len(lane):
                        break
                last = moves[-1] >> 1
            begun = (moves & 1).astype(bool) & (np.arange(LANE)[:, None] < ends)
            out[:, k] = np.bincount(owner, begun.sum(axis=0), len(texts)) if len(owner) else 0
        return out

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Estimated bits a symbol for each text and language; whether the text has a letter."""
        coded = [_folded(t or "") for t in texts]
        some = np.array([bool(len(c)) and bool(c.any()) for c in coded], bool)
        return self.phrases(coded) * self.weights / np.maximum([len(c) for c in coded], 1)[:, None], some


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def learn(docs: DataFrame, chars: int = 24_000, per_language: int = 32) -> tuple[tuple[str, str], ...]:
    """Labelled text of every language of the rows whose fold is learned from.

    Bounds, by parameter, are on rows alone: per_language ids of each language at most, and of their
    texts, which are taken whole and in the order of a hash, those with which the language has no
    more than `chars` characters; the shortest is always taken. A language none of whose texts has
    a letter is not learned. Null and repeated ids and texts: nulls are left out, equal texts count once.
    """
    rows = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = bounded_sample(rows.select("lang", "doc_id"), "doc_id", ["lang"], per_language)
    found = checkpoint(rows.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text", F.length("text").alias("n"), F.xxhash64("text").alias("h")).dropDuplicates(["lang", "h"]))
    by, chosen = defaultdict(list), []
    for lang, n, h in found.select("lang", "n", "h").collect():
        by[lang].append((n, h))
    for lang, sizes in by.items():
        least = min(sizes)
        total = least[0]
        for n, h in sorted(sizes, key=lambda x: x[1]):
            if (n, h) == least or total + n <= chars:
                total += n * ((n, h) != least)
                chosen.append((lang, h))
    if not chosen:
        return ()
    picked = docs.sparkSession.createDataFrame(chosen, found.select("lang", "h").schema)
    texts = defaultdict(list)
    for lang, text in found.join(F.broadcast(picked), ["lang", "h"], "left_semi").select("lang", "text").collect():
        texts[lang].append(text)
    return tuple((lang, "\n".join(sorted(texts[lang], key=lambda t: (hash_of(t), t)))) for lang in sorted(texts))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, from its whole text.

    Null text or one without a letter: `und`, score 0; so too if nothing was learned. Ties go to
    the language first in order. A null id is not held out. Repeated rows repeat, an empty table
    gives no rows, other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            texts, names, scores, block, size = batch.column(2).to_pylist(), [], [], [], 0
            for i, text in enumerate(texts):
                block.append(text)
                size += len(text or "") + LANE
                if size >= BUDGET or i + 1 == len(texts):
                    if parser.names:
                        rates, some = parser.rates(block)
                        best = rates.argmin(axis=1)
                        odds = np.exp(-20 * (rates / np.maximum(rates.min(axis=1, keepdims=True), 1e-9) - 1))
                        names += [parser.names[b] if s else "und" for b, s in zip(best, some, strict=True)]
                        scores += np.where(some, 1 / odds.sum(axis=1), 0).tolist()
                    else:
                        names += ["und"] * len(block)
                        scores += [0.0] * len(block)
                    block, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return source.mapInArrow(run, typed(docs, "doc_id", held_out=T.BooleanType(), lang_pred=T.StringType(), score=T.DoubleType()))
