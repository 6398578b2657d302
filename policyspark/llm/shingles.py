"""Near copies: every pair of texts whose sets of word shingles have a Jaccard similarity of at least `least`.

The search is exact. Two sets of such a similarity share a member among the first
n - ceil(least * n) + 1 of each in any common order (prefix filter); the order is rarest first by
counts over a bounded sample, which decides the speed only. A pair must also fit by its sizes, by
sketches that differ in no more bits than the sets may in members, by how many prefix members it
shares, and by counts of members by class, which tell long texts apart where sketches can't; it is
then checked on the whole sets. Equal texts are one node. Texts whose SimHash
fingerprints are near are linked first, by the same check; then large groups are linked to their
centre, the text most of whose shingles many others have; after each, only pairs that the links so
far leave in different components are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.llm import simhash
from policyspark.llm.common import bounded_sample, checkpoint, components, give_back, known_few, remove, scratch

SLACK, PAIRS, WORDS = 1e-9, 200_000, 100_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict[bytes, int]):
    """Hashes of words, each made at its first lookup; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASHES = Hashes()


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. No words: none. Fewer words than a shingle: one of all.

    Words are hashed once each; a shingle's hash is a polynomial of its words' hashes, mixed.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    h = codes[:n].copy()
    for i in range(1, min(shingle, len(words))):
        h *= FACTOR
        h += codes[i : i + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def node(text: str = "text") -> Column:
    """Equal texts have equal nodes; so have all texts without words."""
    return F.when(F.col(text).rlike(r"\S"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, whose sets are held at once; word hashes are forgotten after the last."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    HASHES.clear()
    give_back()


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, members) for each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = [shingles(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "members"])

    return texts.select("node", "text").mapInArrow(run, "node long, members array<long>")


def one_each(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """One row a node. copied: the nodes that have more; the rows of others don't move."""
    return rows.join(copied, "node", "left_anti").unionByName(rows.join(copied, "node", "left_semi").dropDuplicates(["node"]))


def common_members(texts: DataFrame, shingle: int, rows: int = 4096, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Members (ascending) that several texts of a bounded sample hold, and how many do. The sample's ids are `rows` at most."""
    chosen = texts.join(F.broadcast(bounded_sample(texts, "node", [], rows)), "node", "left_semi").dropDuplicates(["node"])
    counts = _sets(chosen, shingle).select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    found = sorted(map(tuple, counts.orderBy(F.desc("n"), "m").limit(most).collect()))
    return np.array([m for m, _ in found], np.int64), np.array([n for _, n in found], np.int64)


SKETCH = 2  # words of 64 bits


def sketch(members: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * SKETCH classes of members: whether a set has an odd number of it. Two sketches never differ in more bits than their sets do in members."""
    odd = np.bincount((members >> 11) & (64 * SKETCH - 1), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


CLASSES = 256  # of members that `class_counts` counts


def class_counts(members: np.ndarray) -> bytes:
    """How many members each class has, 255 at most. The counts of two sets never differ by more in sum than the sets do in members."""
    return np.minimum(np.bincount((members >> 23) & (CLASSES - 1), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def _prefixes(texts: DataFrame, copied: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, n, prefix, counts by class, s0, ...: the sketch) of each distinct text with words."""
    known, counts = common_members(texts, shingle)

    def first(members: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, members), max(len(known) - 1, 0))
        rarity = np.where(known[at] == members, counts[at], 0) if len(known) else np.zeros(len(members))
        return members[np.lexsort((members, rarity))][: len(members) - math.ceil(least * len(members) - SLACK) + 1]

    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = [shingles(x.as_py(), shingle) for x in batch.column(1)]
            bits = np.array([sketch(m) for m in made], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, made), pa.int32()), pa.array([first(m) for m in made], pa.list_(pa.int64())), pa.array(map(class_counts, made), pa.binary()), *map(pa.array, np.ascontiguousarray(bits.T))], ["node", "n", "prefix", "counts", *names])

    return texts.where("node <> 0").select("node", "text").transform(one_each, copied).mapInArrow(run, "node long, n int, prefix array<long>, counts binary, " + ", ".join(f"{x} long" for x in names))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of a partition sorted by its first, in pieces that hold whole groups."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held and now[0][-1] == held[0][0][0]:
                held.append(now)  # a group of many batches is put together once, at its end
                continue
            now = [np.concatenate(p) for p in zip(*held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [[c[cut:] for c in now]]
            if cut:
                yield [c[:cut] for c in now]
    if held:
        yield [np.concatenate(p) for p in zip(*held, strict=True)]
    give_back()


def _shared(prefixes: DataFrame) -> DataFrame:
    """(member, node, size) of the prefix members that more than one text has, size: how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for member, nodes in _groups(batches):
            _, group, count = np.unique(member, return_inverse=True, return_counts=True)
            size = count[group]
            keep = size > 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(member[keep]), pa.array(nodes[keep]), pa.array(size[keep].astype(np.int64))], ["member", "node", "size"])

    rows = prefixes.select(F.explode("prefix").alias("member"), "node")
    return rows.repartition("member").sortWithinPartitions("member").mapInArrow(run, "member long, node long, size long")


def _candidates(shared: DataFrame, least: float, star: bool) -> DataFrame:
    """Pairs (u, v) that may be similar: of each group its centres' with the others, or all of different roots.

    shared: member, node, n, root, fame and the sketch. A centre is the text of a group whose
    members are in the most groups, which is what copies were made from, among texts of like size.
    No pair leaves a group whose sketches differ more than similar sets can. Of all pairs, those
    are kept that share enough of their prefixes: the prefix that ends first in the order holds at
    least its length less the members that a similar pair may differ in.
    """

    def room(n: np.ndarray, other: np.ndarray) -> np.ndarray:
        return n - np.ceil(least * n - SLACK) + 1 - (n - (n + other) * least / (1 + least))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["u", "v", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for member, nodes, n, root, fame, *words in _groups(batches):
            order = np.lexsort((nodes, n, member))
            member, nodes, n, root, fame = (c[order] for c in (member, nodes, n, root, fame))
            bits = np.stack([w[order] for w in words], axis=1).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
            mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            for low, high in zip(starts[mixed].tolist(), np.r_[starts[1:], len(member)][mixed].tolist(), strict=True):
                ends = low + np.searchsorted(n[low:high], n[low:high] / least + SLACK, side="right")  # larger sets are too large
                left = np.ones(high - low, bool)
                for k in range(low, high) if not star else iter(lambda: low + int(np.where(left, fame[low:high], -1).argmax()) if left.any() else -1, -1):  # noqa: B023
                    if star:
                        begin = low + int(np.searchsorted(n[low:high], least * n[k] - SLACK))
                        near = np.arange(begin, ends[k - low])
                        near = near[left[near - low]]
                        left[near - low] = left[k - low] = False
                    else:
                        near = np.arange(k + 1, ends[k - low])
                    near = near[root[near] != root[k]]
                    apart = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1)
                    near = near[apart <= (n[near] + n[k]) * (1 - least) / (1 + least) + SLACK]
                    if len(near):
                        need = np.zeros(len(near)) if star else np.minimum(room(n[k], n[near]), room(n[near], n[k])) - SLACK
                        found.append((np.minimum(nodes[k], nodes[near]), np.maximum(nodes[k], nodes[near]), need))
                        held += len(near)
                    if held > PAIRS:
                        yield batch(found)
                        found, held = [], 0
        if found:
            yield batch(found)

    rows = shared.select("member", "node", "n", "root", "fame", *[f"s{i}" for i in range(SKETCH)]).repartition("member").sortWithinPartitions("member")
    pairs = rows.mapInArrow(run, "u long, v long, need double")
    return pairs.groupBy("u", "v").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("u", "v")


def _alike(pairs: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose counts(node, n, counts) by class differ by no more than those of similar sets can: texts of others needn't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                u, v, n, m, *held = batch.slice(at, 2000).columns
                one, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for c in held)
                keep = pa.array(np.abs(one - other).sum(axis=1) <= (n.to_numpy() + m.to_numpy()) * (1 - least) / (1 + least) + SLACK)
                yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    pairs = checkpoint(pairs)
    nodes = known_few(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    known = checkpoint(counts.join(nodes, "node", "left_semi"))
    at = lambda end, n, c: known.select(F.col("node").alias(end), F.col("n").alias(n), F.col("counts").alias(c))
    both = pairs.join(at("u", "n", "one"), "u").join(at("v", "m", "other"), "v")
    return both.select("u", "v", "n", "m", "one", "other").mapInArrow(run, "u long, v long")


def _similar(pairs: DataFrame, texts: DataFrame, copied: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar. Texts travel, which pack better than their sets.

    The text of a pair that is in fewer pairs goes to where the other one's is, so a text that many
    are compared with, as centres are, travels once. A text learns where to go by a broadcast of the
    pairs where their count proves them few; then nothing else is moved or stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.zeros(0, np.int64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (hub, node, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                other = shingles(text.as_py(), shingle)
                if node is None:  # a hub's own row comes before those of the texts it is compared with
                    last, one = hub, other
                elif hub == last:
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    keep[i] = shared >= least * (len(one) + len(other) - shared) - SLACK
                else:
                    raise RuntimeError("a text of a pair is missing")
            hubs, others = (batch.column(k).filter(pa.array(keep)).to_numpy() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(hubs, others)), pa.array(np.maximum(hubs, others))], ["u", "v"])
        HASHES.clear()
        give_back()

    pairs = checkpoint(pairs)
    degree = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    both = pairs.join(degree.select(F.col("node").alias("u"), F.col("n").alias("un")), "u").join(degree.select(F.col("node").alias("v"), F.col("n").alias("vn")), "v")
    sent = known_few(both.select(F.when(F.col("vn") > F.col("un"), F.col("v")).otherwise(F.col("u")).alias("hub"), F.when(F.col("vn") > F.col("un"), F.col("u")).otherwise(F.col("v")).alias("node")))
    chosen = lambda ids: texts.join(known_few(ids.distinct()), "node", "left_semi").transform(one_each, copied).select("node", "text")
    others = chosen(sent.select("node")).join(sent, "node").select("hub", "node", "text")
    hubs = chosen(sent.select(F.col("hub").alias("node"))).select(F.col("node").alias("hub"), F.lit(None).cast("long").alias("node"), "text")
    rows = others.unionByName(hubs).repartition("hub").sortWithinPartitions("hub", F.col("node").asc_nulls_first())
    return checkpoint(rows.mapInArrow(run, "u long, v long"))


def _by_fingerprint(texts: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (u, v) of texts whose SimHash fingerprints are equal or within `radius` bits: of each fingerprint's texts the least with the others, and those of linked fingerprints."""
    rows = texts.where("node <> 0").select(F.col("node").alias("doc_id"), "text")
    fps = checkpoint(simhash.fingerprints(rows).select("fp", F.col("doc_id").alias("node")).distinct())
    firsts = checkpoint(fps.groupBy("fp").agg(F.min("node").alias("u"), F.count("*").alias("n")))
    equal = fps.join(firsts.where("n > 1").select("fp", "u"), "fp").where("node <> u").select("u", F.col("node").alias("v"))
    at = lambda end: firsts.select(F.col("fp").alias(end), F.col("u").alias(f"{end}_node"))
    near = simhash.links(firsts.select("fp"), radius).join(at("u"), "u").join(at("v"), "v")
    return equal.unionByName(near.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")))


def near_copies(texts: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) for every node of texts(node, text) that has a near copy: root is the least node it is linked to."""
    spark, copied = texts.sparkSession, known_few(texts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    found = _similar(_by_fingerprint(texts), texts, copied, shingle, least)
    path, kept = scratch(spark, "prefixes"), scratch(spark, "counts")
    _prefixes(texts, copied, shingle, least).write.parquet(path)
    prefixes = spark.read.parquet(path)
    prefixes.select("node", "n", "counts").write.option("compression", "zstd").parquet(kept)
    counts = spark.read.parquet(kept)
    groups = checkpoint(_shared(prefixes))
    fame = groups.groupBy("node").agg(F.sum("size").alias("fame"))
    about = checkpoint(prefixes.drop("prefix", "counts").join(fame, "node"))
    remove(spark, path)
    for star in (True, False):
        rooted = about.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        shared = groups.select("member", "node").join(rooted, "node")
        found = checkpoint(found.unionByName(_similar(_alike(_candidates(shared, least, star), counts, least), texts, copied, shingle, least)))
    remove(spark, kept)
    return components(found)
