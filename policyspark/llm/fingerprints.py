"""Document fingerprints: 128-bit SimHash of weighted terms, found again through permuted block tables.

Terms are the words of the lower-cased text, weighted by the square root of their count; each
term's XXH3-128 hash votes with its weight on every signed bit. Searches within `radius` bits
cut the fingerprint into radius + 1 blocks: any hit agrees on one block at least, so a table
per block, keyed by that block (the permutation that puts it first), finds every hit exactly.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from policyspark.llm.common import checkpoint, hot_keys, lookup, meet

BITS = 128


def fingerprint(text: str) -> np.ndarray:
    """16 bytes, most significant bit first. A text without words: zeros."""
    counts = Counter(text.lower().encode("utf-8", "surrogatepass").split())
    votes, terms = np.zeros(BITS, np.float32), list(counts)
    weights = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    for at in range(0, len(terms), 16384):
        bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms[at : at + 16384])), np.uint8).reshape(-1, BITS // 8), axis=1)
        votes += weights[at : at + 16384] @ bits.astype(np.float32)
    return np.packbits(votes * 2 > weights.sum() + 1e-3 * bool(terms)) if terms else np.zeros(BITS // 8, np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the next text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COLUMNS = ["kind", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "text"]


def _schema(docs: DataFrame) -> T.StructType:
    kinds = [T.StringType(), docs.schema["doc_id"].dataType, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.IntegerType(), T.StringType()]
    return T.StructType([T.StructField(n, k) for n, k in zip(COLUMNS, kinds, strict=True)])


def _row(doc_id: object, text: str, own: np.ndarray, after: str, of_next: np.ndarray) -> tuple:
    other = edited(text, after)
    of_other = own if other == text else fingerprint(other)
    return ("row", doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(), of_other.tobytes().hex(), likeness(own, of_other), likeness(own, of_next), None, None)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document with its fingerprint, its edited text's and the likeness of both and of the next document's.

    Order: doc_id, nulls first, then the text's hash; repeated rows follow each other. Null text
    counts as empty; an empty table gives no rows; a single row follows itself. doc_id keeps its
    type, other columns are not read. Texts move once, dealt by ranges of the order. Only the first
    and last text of a range are seen outside its task: they meet by the numbers of their ranges,
    and nothing but those numbers reaches the driver.
    """
    schema = _schema(docs)
    types = [to_arrow_type(f.dataType) for f in schema]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], COLUMNS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                own = fingerprint(text)
                if last is None:
                    rows.append(("head", doc_id, None, None, None, None, None, None, part, text))
                else:
                    rows.append(_row(last[0], last[1], last[2], text, own))
                last = (doc_id, text, own)
                if len(rows) >= 500:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        if last is not None:
            yield batch_of([("tail", last[0], None, None, None, None, None, None, part, last[1])])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(i, t, fingerprint(t), u, fingerprint(u)) for i, t, u in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            if rows:
                yield batch_of(rows)

    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    made = checkpoint(dealt.select("doc_id", "text").mapInArrow(walk, schema))
    parts = sorted(r[0] for r in made.where("kind = 'head'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, after int")
    first = made.where("kind = 'tail'").select("doc_id", "text", "part").join(F.broadcast(follows), "part")
    heads = made.where("kind = 'head'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    pairs = first.join(heads, "after").select("doc_id", "text", "next")
    return made.where("kind = 'row'").select(COLUMNS[1:8]).unionByName(pairs.mapInArrow(tails, schema).select(COLUMNS[1:8]))


def within(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (query, found, distance) of distinct `fingerprint` hex values within radius bits, equal ones included.

    Null fingerprints are in no pair, repeated ones count once, an empty side gives none. The index
    rows of a block that very many of them share are dealt into parts, to each of which the
    queries of that block go.
    """
    blocks, digits = radius + 1, BITS // 4
    if digits % blocks:
        raise ValueError("radius + 1 has to divide the number of hex digits")
    wide = digits // blocks
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.substring("fingerprint", 1 + i * wide, wide).alias("k")) for i in range(blocks)])
    rows = lambda df, name: df.where("fingerprint is not null").select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.explode(keys).alias("b")).select(name, "b.*")
    of, to = checkpoint(rows(queries, "query")), checkpoint(rows(index, "found"))
    hot = hot_keys(to.groupBy("t", "k").agg(F.count("*").alias("n")), to.count())
    bits = sum((F.bit_count(F.conv(F.substring("query", 1 + i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("found", 1 + i, 8), 16, 10).cast("long"))) for i in range(0, digits, 8)), F.lit(0))
    return meet(to, of, ["t", "k"], hot).where(bits <= radius).select("query", "found", bits.alias("distance")).distinct()


def search_counts(made: DataFrame, step: int = 100, radius: int = 3) -> DataFrame:
    """made with near_queries: how many documents whose id step divides, but itself, lie within radius bits.

    Rows whose id is null or no number are never queries; they are found like any other. Repeated
    rows count each. An empty table gives no rows.
    """
    made = checkpoint(made)
    asked = F.coalesce(F.col("doc_id").try_cast("long") % step == 0, F.lit(False))
    sizes = checkpoint(made.groupBy("fingerprint").agg(F.count("*").alias("n"), F.sum(asked.cast("int")).alias("copies")))
    queries = sizes.where("copies > 0").select(F.col("fingerprint").alias("query"), "copies")
    hits = checkpoint(within(queries.select(F.col("query").alias("fingerprint")), sizes.select("fingerprint"), radius))
    crowded = hot_keys(hits.groupBy("query").agg(F.count("*").alias("n")), hits.count())
    counts = lookup(hits, queries, ["query"], crowded).groupBy(F.col("found").alias("fingerprint")).agg(F.sum("copies").alias("near"))
    out = lookup(made, counts, ["fingerprint"], hot_keys(sizes.select("fingerprint", "n"), made.count()), "left")
    return out.withColumn("near_queries", (F.coalesce("near", F.lit(0)) - asked.cast("int")).cast("long")).select(*made.columns, "near_queries")
