"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is 64 majority votes over the XXH64 hashes of a text's word shingles. Equal
fingerprints are one node, so copies are never expanded. Two fingerprints link when at most
`radius` bits differ. Candidates: the bits are dealt into a ring of segments; by the pigeonring
principle some run of consecutive segments has, for each length l, at most floor(l*radius/m)
differing bits. The run's first segments must therefore be equal (the join key), and the longer
prefixes of the run are checked before the whole distance is. Fingerprints that crowd under a key
are dealt again by the ring of their other bits, under longer keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policyspark.llm.common import FEW, checkpoint, components, hot_keys, lookup, typed

WIDTH, SEED, SLICE = 64, 42, 65536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint. Null, empty or blank text: 0. Fewer words than a shingle: one shingle of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    hashed, votes = xxhash.xxh64_intdigest, np.zeros(WIDTH, np.int64)
    for at in range(0, n, SLICE):
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE], strict=True)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits) for every row, repeated rows and null ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, typed(docs, "doc_id", fp=T.LongType()))


def _part(column: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << bits) - 1))


def _value(word: Column, width: int, low: int, bits: int) -> Column:
    """`bits` bits of a word of `width` bits from bit `low` on, the word being a ring."""
    over = low + bits - width
    if over <= 0:
        return _part(word, low, bits)
    return F.shiftleft(_part(word, 0, over), bits - over).bitwiseOR(_part(word, low, bits - over))


def _runs(width: int, radius: int, m: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the run of each start: as many segments as the budget demands to be equal."""
    cuts = [i * width // m for i in range(m + 1)]
    equal = max(n for n in range(1, m) if n * radius // m == 0)
    return [(cuts[t], (cuts[t + equal] if t + equal <= m else width + cuts[t + equal - m]) - cuts[t]) for t in range(m)]


def _chains(x: Column, width: int, radius: int, m: int) -> Column:
    """The starts from which every longer run of segments of x keeps to its share of the budget, as an array of booleans."""
    cuts = [i * width // m for i in range(m + 1)]
    counts = [F.bit_count(_part(x, a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for t in range(m):
        total, ok = F.lit(0), F.lit(True)
        for n in range(1, m):
            total = total + counts[(t + n - 1) % m]
            ok = ok & (total <= n * radius // m)
        out.append(ok)
    return F.array(*out)


def _dealt(rows: DataFrame, widths: set[int], radius: int, m: int) -> tuple[DataFrame, set[int]]:
    """rows(fp, path, word, width) by each start of their ring: path goes on by the run's value, `ring` and `round` are the ring they were in.

    The rest of the ring, from the run's end on, is the word of a next round.
    """
    by_width, left = None, set()
    for width in sorted(widths):
        made = []
        for t, (low, bits) in enumerate(_runs(width, radius, m)):
            rest = width - bits
            left.add(rest)
            path = F.xxhash64("path", F.lit(t), _value(F.col("word"), width, low, bits))
            made.append(F.struct(path.alias("path"), F.lit(t).alias("t"), _value(F.col("word"), width, (low + bits) % width, rest).alias("word"), F.lit(rest).alias("width")))
        found = F.array(*made)
        by_width = found if by_width is None else F.when(F.col("width") == width, found).otherwise(by_width)
    out = rows.select("fp", F.col("word").alias("ring"), F.col("width").alias("round"), F.explode(by_width).alias("b"))
    return out.select("fp", "b.path", "b.t", "ring", "round", "b.word", "b.width"), left


def links(nodes: DataFrame, radius: int = 2, m: int = 5, bucket: int = 64, stop: int = 10) -> DataFrame:
    """Edges (u, v): every pair of distinct fingerprints `fp` within radius, once or more.

    Keys that more than `bucket` fingerprints share are not joined: what is left of their rings
    once the key's run is taken out is itself a ring within the same budget, so it is dealt by
    pigeonring anew, under longer keys, until keys are small or only `stop` bits are left, which
    2 ** stop fingerprints differ in at most. No key is ever joined that has more than either bound.
    """
    if m <= radius or bucket < 2:
        raise ValueError("a run has to be equal, so there are more segments than the radius; a key is two fingerprints at least")
    rows, widths, found = nodes.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("word"), F.lit(WIDTH).alias("width")), {WIDTH}, None
    while True:
        rounds = sorted(widths)
        rows, widths = _dealt(rows, widths, radius, m)
        last = max(widths) <= stop
        if last:
            cold = rows
        else:
            rows = checkpoint(rows)
            hot = checkpoint(rows.groupBy("path").agg(F.count("*").alias("n")).where((F.col("n") > bucket)).select("path"))
            n = hot.count()
            hot = F.broadcast(hot) if n <= FEW else hot
            cold = rows.join(hot, "path", "left_anti") if n else rows
        cold = cold.select("fp", "path", "t", "ring", "round")
        a, b = cold.alias("a"), cold.alias("b")
        x, ok = F.col("a.ring").bitwiseXOR(F.col("b.ring")), None
        for width in rounds:
            chain = F.element_at(_chains(x, width, radius, m), F.col("a.t") + 1)
            ok = chain if ok is None else F.when(F.col("a.round") == width, chain).otherwise(ok)
        pairs = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.fp") < F.col("b.fp")) & ok & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
        pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
        found = pairs if found is None else found.unionByName(pairs)
        if last or not n:
            return found.distinct()
        rows = checkpoint(rows.join(hot, "path", "left_semi").select("fp", "path", "word", "width"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, m: int = 5, bucket: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null, empty and blank texts have fingerprint zero and link like any other. Null ids count as no
    id: a component of such rows only has a null component_id. Repeated rows repeat; an empty table
    gives none; other columns are not read.
    """
    fps = checkpoint(fingerprints(docs, shingle))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), radius, m, bucket)).withColumnRenamed("node", "fp")
    rooted = checkpoint(nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    rows, fingerprints_ = nodes.agg(F.sum("n"), F.count("*")).first()
    classes = checkpoint(lookup(rooted.select("root", "fp"), least.drop("n"), ["root"], hot_keys(least.select("root", "n"), fingerprints_)).select("fp", "component_id"))
    out = lookup(fps, classes, ["fp"], hot_keys(nodes.select("fp", "n"), rows or 0))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
