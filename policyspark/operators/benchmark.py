"""Settings of the model stage against each other: a sample of clauses, a grid of variants, agreement and cost of each.

All variants see the same clauses through one model stage; only how they are asked differs. Seconds
are measured around a run after a warm-up request, which isn't counted.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.functions.shared import settled
from policyspark.operators import model


@dataclass(frozen=True)
class Variant:
    """A way to ask: its options, whether clauses come with context, the model, and that model's digest."""

    name: str
    options: model.Options = field(default_factory=model.Options)
    context: bool = False
    model: model.ModelFn = model.rule_model
    digest: str = ""


def sampled(rows: DataFrame, longest: int = 2, spread: int = 8) -> DataFrame:
    """Of each agreement's clauses (contract_id, ord, bytes, ...) the longest ones and some evenly spaced over the rest of their order; spread 0: all."""
    by = Window.partitionBy("contract_id")
    rows = rows.withColumns({"_big": F.row_number().over(by.orderBy(F.desc("bytes"), "ord")), "_i": F.row_number().over(by.orderBy("ord")) - 1, "_n": F.count("*").over(by)})
    places = F.array(*[F.bround(F.lit(k) * (F.col("_n") - 1) / max(1, spread - 1)) for k in range(spread)])
    keep = (F.col("_big") <= longest) | F.array_contains(places, F.col("_i").cast("double")) if spread else F.lit(True)
    return rows.where(keep).drop("_big", "_i", "_n")


def compare(clauses: DataFrame, variants: list[Variant], contexts: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(variant, contract_id, ord, label, reason) for each variant, and the seconds of each.

    clauses: contract_id, ord, text. contexts: contract_id, ord, context. All variants have to be of
    one model digest: labels of two models say nothing about settings.
    """
    if len({v.digest for v in variants}) > 1:
        raise ValueError("variants are of different models")
    if len({v.name for v in variants}) < len(variants):
        raise ValueError("names of variants are unique")
    rows = settled(clauses.select("contract_id", "ord", "text"))
    bare = rows.withColumn("context", F.lit(None).cast("string"))
    given = rows.join(contexts, ["contract_id", "ord"], "left") if contexts is not None else bare
    told, seconds = None, {}
    for v in variants:
        requests = settled(model.packed(given if v.context else bare, v.options))
        model.answered(requests.limit(1), v.model).write.format("noop").mode("overwrite").save()  # the warm-up
        began = time.time()
        made = settled(model.labels(model.answered(requests, v.model)).withColumn("variant", F.lit(v.name)))
        seconds[v.name] = time.time() - began
        sizes = requests.groupBy("contract_id").agg(F.count("*").alias("requests"), F.sum(F.octet_length("value_json")).alias("input_bytes"))
        made = made.join(sizes, "contract_id")
        told = made if told is None else told.unionByName(made)
    return told.select("variant", "contract_id", "ord", "label", "reason", "requests", "input_bytes"), seconds


def summary(told: DataFrame, baseline: str, seconds: dict[str, float] | None = None) -> DataFrame:
    """A row a variant: clauses, requests, input_bytes, failed, label_agreement with the baseline on the clauses both answered, and where seconds are given clauses_per_second and speedup."""
    base = told.where(F.col("variant") == baseline).select("contract_id", "ord", F.col("label").alias("base"), F.coalesce("reason", F.lit("")).alias("base_reason"))
    bad = lambda c: F.lower(F.coalesce(c, F.lit(""))).rlike("invalid answer|no answer|limit|timeout")
    each = told.join(base, ["contract_id", "ord"], "left").withColumn("failed", bad(F.col("reason"))).withColumn("both", ~F.col("failed") & ~bad(F.col("base_reason")) & F.col("base").isNotNull())
    sizes = told.select("variant", "contract_id", "requests", "input_bytes").distinct().groupBy("variant").agg(F.sum("requests").alias("requests"), F.sum("input_bytes").alias("input_bytes"))
    out = each.groupBy("variant").agg(F.count("*").alias("clauses"), F.sum(F.col("failed").cast("long")).alias("failed"), F.avg(F.when(F.col("both"), (F.col("label") == F.col("base")).cast("int"))).alias("label_agreement")).join(sizes, "variant")
    if seconds is None:
        return out
    took = F.try_element_at(F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv]), F.col("variant"))
    return out.withColumns({"clauses_per_second": F.col("clauses") / took, "speedup": F.lit(seconds[baseline]) / took})
