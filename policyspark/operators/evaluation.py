"""Label references: their integrity, review, runs and reports.

A reference is four tables: sources (contract_id, sha, split, source_type, sampling, chunks,
content_sha), inputs (input_id, contract_id, chunk_id, text, context: array of context ids), contexts
(context_id, text) and cases (case_id, input_id, split, source_type, cohort, group_id, label,
review_status, reviewer, rationale, open). Checks are tables of violations, so they say all that
is wrong at once; whoever loads or scores raises on any.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.shared import settled
from policyspark.operators import metrics

SPLITS, STATUSES = ("dev", "test"), ("draft", "reviewed")


@dataclass(frozen=True)
class Reference:
    sources: DataFrame
    inputs: DataFrame
    contexts: DataFrame
    cases: DataFrame
    version: str = "1"


def gold_fault() -> Column:
    """Why a case's gold label is not acceptable; null if it is."""
    reviewed = F.col("review_status") == "reviewed"
    return (
        F.when(F.col("review_status").isNull() | ~F.col("review_status").isin(*STATUSES), "unknown review status")
        .when(reviewed & (F.trim(F.coalesce("reviewer", F.lit(""))) == ""), "reviewed without a reviewer")
        .when(reviewed & F.coalesce("open", F.lit(False)), "reviewed while open")
        .when(F.col("label").isNull() | ~F.col("label").isin(*metrics.LABELS), "unknown label")
    )


def input_sha() -> Column:
    """Digest of what a case is judged on: its text and the texts of its context in order."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce("text", F.lit("")), F.array_join("context_texts", "\x1e")), 256)


def inputs_of(reference: Reference, cases: DataFrame | None = None) -> DataFrame:
    """(case_id, input_id, contract_id, text, context_texts, input_sha): the evidence of each case, contexts in their order. Unknown contexts count as absent."""
    cases = reference.cases if cases is None else cases
    rows = cases.select("case_id", "input_id").join(reference.inputs, "input_id")
    named = rows.select("case_id", F.posexplode("context").alias("seq", "context_id")).join(reference.contexts.withColumnRenamed("text", "context_text"), "context_id")
    texts = named.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "context_text"))), lambda x: x["context_text"]).alias("context_texts"))
    made = rows.join(texts, "case_id", "left").withColumn("context_texts", F.coalesce("context_texts", F.array().cast("array<string>")))
    return made.select("case_id", "input_id", "contract_id", "text", "context_texts", input_sha().alias("input_sha"))


def content_sha(inputs: DataFrame) -> DataFrame:
    """(contract_id, chunks, distinct_chunks, content_sha) of the texts of each contract, in the order of their chunk ids."""
    one = F.struct("chunk_id", F.md5("text").alias("t"))
    lines = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(x["chunk_id"], F.lit(" "), x["t"]))
    return inputs.groupBy("contract_id").agg(F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("distinct_chunks"), F.sha2(F.array_join(lines, "\n"), 256).alias("content_sha"))


def violations(reference: Reference, files: DataFrame | None = None) -> DataFrame:
    """(problem, key) for everything that breaks a reference. files: (contract_id, sha) as the sources are now."""
    s, i, c = reference.sources, reference.inputs, reference.cases
    said = lambda df, problem, key: df.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("key"))
    placed = c.join(i.select("input_id", "contract_id"), "input_id", "left").join(s.select("contract_id", F.col("split").alias("own_split"), F.col("source_type").alias("own_type"), "sampling"), "contract_id", "left")
    full = s.where("sampling = 'full_document'").select("contract_id", F.col("chunks").alias("said_chunks"), F.col("content_sha").alias("said_sha"))
    held = full.join(content_sha(i), "contract_id", "left")
    changed = F.coalesce((F.col("chunks") == F.col("said_chunks")) & (F.col("distinct_chunks") == F.col("chunks")) & (F.col("content_sha") == F.col("said_sha")), F.lit(False))
    covered = i.join(full.select("contract_id"), "contract_id", "left_semi").join(c.groupBy("input_id").agg(F.count("*").alias("n")), "input_id", "left")
    faults = [
        said(s.where(F.col("split").isNull() | ~F.col("split").isin(*SPLITS)), "source without a split", "contract_id"),
        said(s.where("source_type <> 'real'"), "source is not real", "contract_id"),
        said(s.groupBy("sha").agg(F.countDistinct("split").alias("n")).where("n > 1"), "source in both splits", "sha"),
        said(c.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1"), "case is not unique", "case_id"),
        said(c.join(i, "input_id", "left_anti"), "input is missing", "case_id"),
        said(placed.where("source_type <> 'real' or own_type <> 'real'"), "case is not real", "case_id"),
        said(placed.where("own_split is not null and not (split <=> own_split)"), "case left its source's split", "case_id"),
        said(i.select("input_id", F.explode("context").alias("context_id")).join(reference.contexts, "context_id", "left_anti").select("input_id").distinct(), "context is missing", "input_id"),
        c.select(gold_fault().alias("problem"), F.col("case_id").cast("string").alias("key")).where("problem is not null"),
        said(held.where(~changed), "document changed", "contract_id"),
        said(covered.where("coalesce(n, 0) <> 1"), "chunk is not covered once", "input_id"),
    ]
    if files is not None:
        faults.append(said(s.join(files.withColumnRenamed("sha", "now"), "contract_id", "left").where("not (sha <=> now)"), "source file changed", "contract_id"))
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out


def load(reference: Reference, files: DataFrame | None = None) -> Reference:
    """The reference, if nothing breaks it; ValueError names the first faults otherwise."""
    found = violations(reference, files).orderBy("problem", "key").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.key}" for r in found))
    return reference


def digest(reference: Reference) -> str:
    """One hash of all rows of a reference, whatever their order."""
    parts = []
    for df in (reference.sources, reference.inputs, reference.contexts, reference.cases):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        n, total = df.agg(F.count("*"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))).first()
        parts.append(f"{n}:{total}")
    return hashlib.sha256("|".join([reference.version, *parts]).encode()).hexdigest()


def summary(reference: Reference) -> DataFrame:
    """(split, label, cases, reviewed) of a reference."""
    return reference.cases.groupBy("split", "label").agg(F.count("*").alias("cases"), F.sum((F.col("review_status") == "reviewed").cast("int")).alias("reviewed"))


def review_packet(reference: Reference, split: str) -> DataFrame:
    """The cases of a split with their evidence and empty gold, for a reader who has seen no label."""
    if split not in SPLITS:
        raise ValueError("a split is dev or test")
    none = F.lit(None).cast("string")
    cases = reference.cases.where(F.col("split") == split)
    return inputs_of(reference, cases).select("case_id", "text", "context_texts", "input_sha", F.lit(split).alias("split"), none.alias("label"), F.lit("draft").alias("review_status"), F.lit("").alias("reviewer"), F.lit("").alias("rationale"))


def packet_faults(reference: Reference, packet: DataFrame) -> DataFrame:
    """(problem, key) of a filled packet: repeated, unknown or wrong-split cases, changed evidence, bad or unreasoned reviews, no review at all."""
    said = lambda df, problem: df.select(F.lit(problem).alias("problem"), F.col("case_id").cast("string").alias("key"))
    now = inputs_of(reference).select("case_id", F.col("input_sha").alias("now_sha")).join(reference.cases.select("case_id", F.col("split").alias("own_split")), "case_id")
    both = packet.join(now, "case_id", "left")
    done = packet.where("review_status = 'reviewed'").withColumn("open", F.lit(False))
    none = packet.agg(F.sum((F.col("review_status") == "reviewed").cast("int")).alias("n")).where("coalesce(n, 0) = 0").select(F.lit("no completed review").alias("problem"), F.lit(None).cast("string").alias("key"))
    parts = [
        said(packet.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1"), "case is repeated"), said(both.where("own_split is null"), "case is unknown"), said(both.where("own_split <> split"), "case of the other split"),
        said(both.where("now_sha is not null and not (now_sha <=> input_sha)"), "evidence changed"), done.select(gold_fault().alias("problem"), F.col("case_id").cast("string").alias("key")).where("problem is not null"),
        said(done.where(F.trim(F.coalesce("rationale", F.lit(""))) == ""), "review without a rationale"), none,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_reviews(reference: Reference, packet: DataFrame) -> Reference:
    """A copy of the reference with the packet's completed reviews in place of its labels; a faulty packet raises."""
    found = packet_faults(reference, packet).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.key}" for r in found))
    new = packet.where("review_status = 'reviewed'").select("case_id", *[F.col(c).alias(f"_{c}") for c in ("label", "review_status", "reviewer", "rationale")])
    both = reference.cases.join(new, "case_id", "left")
    done = F.col("_label").isNotNull()
    columns = [F.when(done, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "open" else F.coalesce(f"_{c}", c).alias(c) if c in ("label", "review_status", "reviewer", "rationale") else F.col(c) for c in reference.cases.columns]
    return replace(reference, cases=both.select(columns))


def code_fingerprints(folder: str) -> dict[str, str]:
    """SHA-256 of every Python file under a folder, by its path there: what a run was made with."""
    found = {}
    for root, _, names in sorted(os.walk(folder)):
        for name in sorted(names):
            if name.endswith(".py"):
                with open(os.path.join(root, name), "rb") as f:
                    found[os.path.relpath(os.path.join(root, name), folder)] = hashlib.sha256(f.read()).hexdigest()
    return found


def limited(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order; 0 means all."""
    if n < 0:
        raise ValueError("a limit is no less than 0, which means all")
    return rows.orderBy(*order).limit(n) if n else rows


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of what only one of two sets has; none if they are equal."""
    one = a.select(key).distinct().join(b.select(key), key, "left_anti").select(key, F.lit("first").alias("side"))
    return one.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").select(key, F.lit("second").alias("side")))


def run(reference: Reference, label: Callable[[DataFrame], DataFrame], split: str, path: str | None = None, most: int = 0) -> DataFrame:
    """(case_id, input_sha, label, error) for the cases of a split.

    label: (case_id, text, context_texts) to (case_id, label, error). With a path, predictions there
    whose evidence is unchanged are kept, the rest is asked and added, so a run that broke off goes
    on where it was. The reference must not change meanwhile: it is digested before and after.
    """
    spark, before = reference.cases.sparkSession, digest(reference)
    cases = limited(reference.cases.where(F.col("split") == split), most, "case_id")
    wanted = settled(inputs_of(reference, cases))
    have = None
    if path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
            have = spark.read.parquet(path).join(wanted.select("case_id", "input_sha"), ["case_id", "input_sha"], "left_semi")
    asked = wanted if have is None else wanted.join(have, "case_id", "left_anti")
    answers = label(asked.select("case_id", "text", "context_texts"))
    new = asked.select("case_id", "input_sha").join(answers, "case_id", "left").select("case_id", "input_sha", "label", F.when(F.col("label").isNull() & F.col("error").isNull(), "Missing prediction").otherwise(F.col("error")).alias("error"))
    if path is not None:
        new.write.mode("append").parquet(path)
        new = spark.read.parquet(path).join(wanted.select("case_id", "input_sha"), ["case_id", "input_sha"], "left_semi").dropDuplicates(["case_id"])
    out = settled(new)
    if digest(reference) != before:
        raise ValueError("the reference changed during the run")
    return out


def report_faults(reference: Reference, predictions: DataFrame, split: str) -> DataFrame:
    """(problem, key) that forbid a score: unknown or repeated cases, predictions made on other evidence."""
    own = inputs_of(reference, reference.cases.where(F.col("split") == split)).select("case_id", F.col("input_sha").alias("now_sha"))
    both = predictions.join(own, "case_id", "left")
    said = lambda df, problem: df.select(F.lit(problem).alias("problem"), F.col("case_id").cast("string").alias("key"))
    twice = predictions.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")
    return said(both.where("now_sha is null"), "case is unknown").unionByName(said(both.where("now_sha <> input_sha"), "evidence changed")).unionByName(said(twice, "case is repeated"))


def scored(reference: Reference, predictions: DataFrame, split: str, require_reviewed: bool = False) -> DataFrame:
    """A row per selected case: cohort, contract_id, group_id, gold, predicted (ERROR where missing, failed or unknown), reviewed."""
    found = report_faults(reference, predictions, split).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.key}" for r in found))
    cases = reference.cases.where(F.col("split") == split)
    if require_reviewed and not cases.where("review_status <> 'reviewed'").isEmpty():
        raise ValueError("selected cases are not all reviewed")
    gold = cases.join(reference.inputs.select("input_id", "contract_id"), "input_id").select("case_id", F.concat_ws("/", "source_type", "cohort").alias("cohort"), "contract_id", "group_id", F.col("label").alias("gold"), (F.col("review_status") == "reviewed").alias("reviewed"))
    return metrics.outcome(gold, predictions.where("error is null").select("case_id", "label"), ["case_id"])


def report(rows: DataFrame, reps: int = 500) -> DataFrame:
    """A row per cohort of scored rows: accuracy with its interval, routing, macro scores with a cluster interval, the mean over contracts, whether all is reviewed."""
    base = metrics.summary(rows, "cohort")
    macro = metrics.macro(metrics.by_class(rows, "cohort"), "cohort")
    contracts = metrics.contract_macro(rows, ["cohort"], "contract_id")
    spread = metrics.bootstrap_macro(rows, ["cohort"], "contract_id", "group_id", reps)
    reviewed = rows.groupBy("cohort").agg(F.when(F.min(F.col("reviewed").cast("int")) == 1, "reviewed").otherwise("provisional").alias("status"))
    return base.join(macro, "cohort").join(contracts, "cohort").join(spread, "cohort", "left").join(reviewed, "cohort")
