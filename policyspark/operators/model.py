"""The model stage: gates before it, a cache around it, packed requests, two passes.

A model is any function of an iterator of pandas frames (request_id, value_json) that yields frames
(request_id, answer_json, error), so it runs in mapInPandas wherever it lives: a replay table, rules
of thumb, an HTTP client.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.functions import text as tx
from policyspark.functions.grouped import map_groups
from policyspark.functions.shared import settled

ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
LABELS = ("RELEVANT", "NOT_RELEVANT", "NEEDS_CONTEXT")
ANSWERS = "request_id string, answer_json string, error string"


@dataclass(frozen=True)
class Options:
    """Settings of a model run, checked when made."""

    context: int = 32_768
    output: int = 12_288
    batch: int = 16
    workers: int = 8
    timeout: int = 900
    temperature: float = 0.0

    def __post_init__(self) -> None:
        for name, low, high in (("context", 2_048, 1 << 20), ("output", 64, 1 << 17), ("batch", 1, 16), ("workers", 1, 32), ("timeout", 1, 86_400), ("temperature", 0, 2)):
            if isinstance(v := getattr(self, name), bool) or not low <= v <= high:
                raise ValueError(f"{name} has to lie in {low} to {high}")

    @property
    def bytes(self) -> int:
        """What a request may weigh: two and a half bytes for each token that is left."""
        return max(0, int((self.context - self.output - 1_024) * 2.5))


def rule_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels by rule of thumb: duties, permissions, bans and definitions are relevant, a `clause above` needs context."""
    for batch in batches:
        answers = []
        for value in batch["value_json"]:
            out = [{"chunk_id": c["chunk_id"], "label": "NEEDS_CONTEXT" if re.search(r"(?i)\b(?:above|aforesaid)\b", c["text"]) and not c.get("context") else "RELEVANT" if re.search(r"(?i)\b(?:must|may|shall|means)\b", c["text"]) else "NOT_RELEVANT"} for c in json.loads(value)]
            answers.append(json.dumps(out))
        yield pd.DataFrame({"request_id": batch["request_id"], "answer_json": answers, "error": [None] * len(batch)})


def gated(clauses: DataFrame) -> DataFrame:
    """clauses with gate and label where a predicate decides: titles, delivery duties, bare options. Else both are null."""
    heading, duty, option = tx.standalone_heading(F.col("heading"), F.col("text")), tx.information_duty(F.col("text")), tx.checkbox_option(F.col("text"), F.col("heading"), F.col("context").isNotNull() if "context" in clauses.columns else None)
    gate = F.when(heading, "heading").when(duty, "delivery duty").when(option, "option")
    return clauses.withColumn("gate", gate).withColumn("label", F.when(heading, "NOT_RELEVANT").when(duty, "RELEVANT").when(option, "NEEDS_CONTEXT"))


def packed(rows: DataFrame, options: Options) -> DataFrame:
    """Consecutive clauses of an agreement in requests of at most `batch` clauses and the byte budget: request_id, value_json."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, size = [], [], 0
        for r in pdf.itertuples():
            one = {"chunk_id": str(r.ord), "text": r.text, **({"context": r.context} if r.context else {})}
            n = len(json.dumps(one, ensure_ascii=False).encode())
            if batch and (len(batch) == options.batch or size + n > options.bytes):
                out.append(batch)
                batch, size = [], 0
            batch.append(one)
            size += n
        out.append(batch)
        key = pdf["contract_id"].iloc[0]
        return pd.DataFrame([[f"{key}/{b[0]['chunk_id']}", key, json.dumps(b, ensure_ascii=False)] for b in out], columns=["request_id", "contract_id", "value_json"])

    return map_groups(rows.select("contract_id", "ord", "text", "context"), "contract_id", ["ord"], walk, "request_id string, contract_id string, value_json string")


def halving(model: ModelFn) -> ModelFn:
    """model, with a request that failed or whose answer can't be read split in two until its parts succeed; a single clause that fails needs context.

    All requests of a batch are asked together, then all their halves, and so on. Output limits are not split.
    """

    def readable(text: object, items: list[dict]) -> list[dict] | None:
        try:
            got = json.loads(text)
            fits = [g["chunk_id"] for g in got] == [c["chunk_id"] for c in items] and all(g["label"] in LABELS for g in got)
        except (TypeError, ValueError, KeyError):
            return None
        return [{"chunk_id": g["chunk_id"], "label": g["label"], "reason": str(g.get("reason") or "")} for g in got] if fits else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told: list[dict[str, dict]] = [{} for _ in range(len(batch))]
            open_ = [(i, json.loads(v)) for i, v in enumerate(batch["value_json"])]
            while open_:
                frame = pd.DataFrame({"request_id": [f"{batch['request_id'].iloc[i]}#{n}" for n, (i, _) in enumerate(open_)], "value_json": [json.dumps(items, ensure_ascii=False) for _, items in open_]})
                got = {r: (a, e) for answers in model(iter([frame])) for r, a, e in zip(answers["request_id"], answers["answer_json"], answers["error"], strict=True)}
                again = []
                for request, (i, items) in zip(frame["request_id"], open_, strict=True):
                    answer, error = got.get(request, (None, "no answer"))
                    error = error if isinstance(error, str) else None
                    read = readable(answer, items) if error is None else None
                    if read is not None:
                        told[i] |= {g["chunk_id"]: g for g in read}
                    elif len(items) == 1 or "output limit" in (error or ""):
                        told[i] |= {c["chunk_id"]: {"chunk_id": c["chunk_id"], "label": "NEEDS_CONTEXT", "reason": error or "invalid answer", "failed": True} for c in items}
                    else:
                        again += [(i, items[: len(items) // 2]), (i, items[len(items) // 2 :])]
                open_ = again
            answers = [json.dumps([told[i][c["chunk_id"]] for c in json.loads(v)]) for i, v in enumerate(batch["value_json"])]
            yield pd.DataFrame({"request_id": batch["request_id"], "answer_json": answers, "error": [None] * len(batch)})

    return run


class Responses:
    """Answers kept by fingerprint in an append-only table. What is appended last counts: an answer, or that it was rejected."""

    SCHEMA = "fingerprint string, answer_json string, rejected boolean, at long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def latest(self) -> DataFrame:
        """(fingerprint, answer_json, rejected): the last state of each."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy("fingerprint").agg(F.max_by(F.struct("answer_json", "rejected"), "at").alias("s")).select("fingerprint", "s.*")

    def append(self, answers: DataFrame, rejected: Column | bool = False) -> None:
        """Adds answers (fingerprint, answer_json), good or rejected."""
        told = rejected if isinstance(rejected, Column) else F.lit(rejected)
        answers.select("fingerprint", "answer_json", told.alias("rejected"), F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(self.path)

    def reject(self, fingerprints: DataFrame) -> None:
        """Answers that turned out wrong are asked for again."""
        self.append(fingerprints.select("fingerprint", F.lit(None).cast("string").alias("answer_json")).distinct(), True)


def fingerprinted(requests: DataFrame, settings: str = "") -> DataFrame:
    """requests with the fingerprint of the settings and what is asked."""
    return requests.withColumn("fingerprint", F.sha2(F.concat(F.lit(settings), F.lit("\n"), "value_json"), 256))


def misses(keyed: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests that no answer is kept for, or a rejected one."""
    return keyed.join(responses.where("not rejected").select("fingerprint"), "fingerprint", "left_anti")


def answered(requests: DataFrame, model: ModelFn, responses: DataFrame | Responses | None = None, settings: str = "") -> DataFrame:
    """requests with fingerprint, answer_json and whether it came from responses (fingerprint, answer_json, rejected: a row each).

    Equal requests that are asked are asked once. A store keeps what is new; an answer that failed in
    part is kept as rejected, and asked for again next time.
    """
    keyed = fingerprinted(requests, settings)
    known = responses.latest() if isinstance(responses, Responses) else responses
    keyed = settled(keyed) if known is not None else keyed
    asked = misses(keyed, known) if known is not None else keyed
    once = asked.groupBy("fingerprint").agg(F.min("request_id").alias("request_id"), F.first("value_json").alias("value_json"))
    told = once.select(F.col("fingerprint").alias("request_id"), "value_json").mapInPandas(halving(model), ANSWERS).select(F.col("request_id").alias("fingerprint"), "answer_json")
    if isinstance(responses, Responses):
        told = settled(told)
        responses.append(told, F.contains("answer_json", F.lit('"failed": true')))
    fresh = asked.join(told, "fingerprint").withColumn("cached", F.lit(False))
    if known is None:
        return fresh
    return fresh.unionByName(keyed.join(known.where("not rejected").select("fingerprint", "answer_json"), "fingerprint").withColumn("cached", F.lit(True)).select(fresh.columns))


def labels(answers: DataFrame) -> DataFrame:
    parsed = F.from_json("answer_json", "array<struct<chunk_id string, label string, reason string>>")
    return answers.select("contract_id", F.explode(parsed).alias("a")).select("contract_id", F.col("a.chunk_id").cast("int").alias("ord"), "a.label", "a.reason")


def classify(clauses: DataFrame, model: ModelFn = rule_model, options: Options | None = None, context: DataFrame | None = None, responses: Responses | None = None, settings: str = "") -> DataFrame:
    """label, gate and pass of every clause.

    Gated clauses never reach the model. A second pass asks again about those that need context, if
    `context` (contract_id, ord, context: text) has some for them. responses: a store of answers, so
    that a second run asks nothing it was told; settings: what model and options they are of.
    """
    options = options or Options()
    rows = gated(clauses)
    open_ = rows.where("gate is null").withColumn("context", F.lit(None).cast("string"))
    first = labels(answered(packed(open_, options), model, responses, settings)).withColumn("pass", F.lit(1))
    if context is not None:
        again = open_.drop("context").join(first.where("label = 'NEEDS_CONTEXT'").select("contract_id", "ord"), ["contract_id", "ord"]).join(context, ["contract_id", "ord"])
        second = labels(answered(packed(again, options), model, responses, settings)).withColumn("pass", F.lit(2))
        first = first.unionByName(second).groupBy("contract_id", "ord").agg(F.max_by("label", "pass").alias("label"), F.max_by("reason", "pass").alias("reason"), F.max("pass").alias("pass"))
    decided = rows.where("gate is not null").select("contract_id", "ord", "label", F.lit(None).cast("string").alias("reason"), "gate", F.lit(0).alias("pass"))
    return decided.unionByName(first.withColumn("gate", F.lit(None).cast("string")).select(decided.columns))
