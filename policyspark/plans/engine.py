"""Stages in order: each reads the table before it, writes its own and makes later ones stale."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.functions.shared import settled
from policyspark.operators import context, generation, model, policy, segment
from policyspark.sources.tables import drop_contracts, write_stage

STAGES = ("blocks", "clauses", "labels", "evidence", "outcomes", "policy", "review")


class Engine:
    """Stage tables under root, dealt into buckets by agreement. A run concerns the agreements whose blocks it is given, or all."""

    def __init__(self, spark: SparkSession, root: str, model_fn: model.ModelFn = model.rule_model, options: model.Options | None = None, planner: model.ModelFn = generation.rule_planner, reviewer: model.ModelFn = generation.rule_reviewer):
        self.spark, self.root, self.model, self.options, self.planner, self.reviewer = spark, root.rstrip("/"), model_fn, options or model.Options(), planner, reviewer
        self.runs: list[dict] = []
        self._busy = threading.Lock()

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def table(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage)).drop("bucket")

    def _place(self, stage: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(stage))
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, stage: str) -> bool:
        p, fs = self._place(stage)
        return fs.exists(p)

    def invalidate(self, stage: str, contracts: DataFrame | None = None) -> None:
        """Removes this stage and those after it: of the agreements in contracts(contract_id), or whole."""
        for name in STAGES[STAGES.index(stage) :]:
            if self.exists(name):
                if contracts is None:
                    p, fs = self._place(name)
                    fs.delete(p, True)
                else:
                    drop_contracts(self.spark, self.path(name), contracts)

    reset = invalidate

    def _rows(self, stage: str, blocks: DataFrame | None, only: DataFrame | None) -> DataFrame:
        def held(name: str) -> DataFrame:
            rows = self.table(name)
            return rows if only is None else rows.join(only, "contract_id", "left_semi")

        if stage == "blocks":
            if blocks is None:
                raise ValueError("the first stage needs blocks")
            return blocks
        if stage == "clauses":
            return segment.segmented(held("blocks"))
        clauses = held("clauses")
        if stage == "labels":
            texts = clauses.select("contract_id", F.col("ord").alias("target_ord"), "text")
            pairs = context.ancestry(context.scoped(clauses)).select("contract_id", "ord", "target_ord").join(texts, ["contract_id", "target_ord"])
            above = pairs.groupBy("contract_id", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target_ord", "text"))), lambda x: x["text"]), "\n").alias("context"))
            return model.classify(clauses, self.model, self.options, above, model.Responses(self.spark, self.path("responses")), f"{self.model.__module__}.{self.model.__qualname__} {self.options}")
        if stage == "evidence":
            rows = settled(context.scoped(clauses))
            kept = held("labels").where("label <> 'NOT_RELEVANT'").select("contract_id", "ord")
            blocks_ = held("blocks")
            placed = blocks_ if "y0" in blocks_.columns else blocks_.withColumn("y0", F.lit(None).cast("double"))
            attached = context.disclaimers(clauses).unionByName(context.table_context(placed, clauses))
            return kept.join(context.edges(rows, attached), ["contract_id", "ord"], "left")
        if stage == "outcomes":
            kept = held("labels").where("label <> 'NOT_RELEVANT'").select("contract_id", "ord")
            texts = clauses.select("contract_id", F.col("ord").alias("target_ord"), "text")
            evidence = held("evidence").where("target_ord is not null").join(texts, ["contract_id", "target_ord"]).select("contract_id", "ord", "target_ord", F.coalesce("def_text", "text").alias("context"))
            return generation.generate(clauses.join(kept, ["contract_id", "ord"], "left_semi"), evidence, self.planner, self.reviewer)
        if stage == "policy":
            return generation.policy_rules(held("outcomes"))
        return policy.rollup(generation.review(held("policy"), clauses, self.reviewer), held("policy"))

    def policies(self) -> DataFrame:
        """Status, counts and coverage of each agreement."""
        return generation.policies(self.table("outcomes"), self.table("clauses"))

    def run(self, blocks: DataFrame | None = None, through: str = "review", step: str | None = None, contracts: DataFrame | None = None) -> DataFrame:
        """All stages up to `through`, or one `step` whose predecessor is ready, for the agreements of blocks, of contracts, or all. Returns the last table.

        A stage is made whole before its old rows go, so a run that fails leaves what was there. One
        run at a time.
        """
        if not self._busy.acquire(blocking=False):
            raise RuntimeError("a run is going on")
        try:
            chosen = (step,) if step else STAGES[: STAGES.index(through) + 1]
            if blocks is None and not step:
                chosen = chosen[1:]
            only = contracts if contracts is not None else settled(blocks.select("contract_id").distinct()) if blocks is not None else None
            for stage in chosen:
                i = STAGES.index(stage)
                if i and not self.exists(STAGES[i - 1]):
                    raise RuntimeError(f"{stage} needs {STAGES[i - 1]}")
                began, entry = time.time(), {"stage": stage, "status": "running"}
                self.runs.append(entry)
                try:
                    made = settled(self._rows(stage, blocks, only))
                    if only is None and self.exists(stage):
                        self.invalidate(stage)
                    write_stage(made, self.path(stage), stage)
                    if i + 1 < len(STAGES) and only is not None:
                        self.invalidate(STAGES[i + 1], only)
                    entry |= {"status": "completed", "seconds": time.time() - began}
                except Exception as e:
                    entry |= {"status": "failed", "seconds": time.time() - began, "error": str(e)[:500]}
                    raise
            return self.table(chosen[-1])
        finally:
            self._busy.release()

    def cancel(self) -> None:
        """Ends the running stage's jobs; the run then fails and its stage stays as it was."""
        self.spark.sparkContext.cancelAllJobs()

    def status(self) -> list[dict]:
        """For each stage whether it is ready, its rows, the labels it counted, how its last run ended."""
        last = {r["stage"]: r for r in self.runs}
        out = []
        for s in STAGES:
            ready = self.exists(s)
            one = {"stage": s, "ready": ready, "rows": self.table(s).count() if ready else 0, "run": last.get(s)}
            if ready and s == "labels":
                one["labels"] = {r["label"]: r["count"] for r in self.table(s).groupBy("label").count().collect()}
            out.append(one)
        return out
