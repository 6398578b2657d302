"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Quality (texts under the threshold go), near duplicates (one document of each group stays),
benchmark leaks (documents that hold an item go), secrets (replaced in place), pieces (the ids of
sampled segmentations). SQL can express none of the models, so ORACLE_SQL is None and the stages
are tested against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm import decontam, quality, secret_scan, sentpiece, shingles
from policyspark.llm.common import checkpoint, known_few, quoted, scratch, table, unused

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, repeated rows each. Learned from the tables of sf_dir.

    Null, empty and blank texts go. Columns may have any names.
    """
    return quality.kept(docs, quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least id, null ids last, then the least text hash.

    Near: sets of five-word shingles with a Jaccard similarity of 0.8 or more, found exactly: first
    among texts whose SimHash fingerprints are near, then among all that these links leave apart. Only
    likeness makes a group: rows that share an id or have none stay unless their texts are near.
    Null, empty and blank texts are one group; rows that repeat in every column are one row. A
    table's own columns may have any names. Rows to be dropped, or that repeat, are broadcast where
    their count proves them few, so the others don't move; beyond that they meet in a shuffle.
    """
    node, row = (unused(docs.columns, name) for name in ("_node", "_row"))
    keyed = docs.withColumn(node, shingles.node()).withColumn(row, F.xxhash64(*[F.col(quoted(c)) for c in docs.columns]))
    places = checkpoint(keyed.groupBy(F.col(node).alias("node"), F.col(row).alias("row")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    firsts = places.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "row")).alias("first"))
    roots = shingles.near_copies(keyed.select(F.col(node).alias("node"), "text"))
    kept = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = checkpoint(kept.select("first.node", "first.row"))
    names = lambda df: known_few(df.select(F.col("node").alias(node), F.col("row").alias(row)))
    gone = names(places.join(stay, ["node", "row"], "left_anti"))
    again = names(places.where("n > 1").join(stay, ["node", "row"], "left_semi"))
    once = keyed.join(gone, [node, row], "left_anti").join(again, [node, row], "left_anti")
    return once.unionByName(keyed.join(again, [node, row], "left_semi").dropDuplicates([node, row])).select([F.col(quoted(c)) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and characters counted anew."""
    return secret_scan.redact(docs, secret_scan.learn(secret_scan.labelled_findings(spark)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document as piece ids."""
    return sentpiece.sampled(docs, sentpiece.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("sentencepiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; the stages before it are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
