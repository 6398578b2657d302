"""Policies from clauses: gates, a plan by a model, its compilation, a review, a second attempt, and the merge of all.

Generation is a table of states. An attempt asks a model for plans of the clauses that are still
open, compiles them as columns (`compiler`), asks the reviewer, and a transition tells what becomes
of each clause: decided, or open again with feedback and the best rules so far. Each table is
written before the next is made from it, so a model is asked once whatever executors are lost.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.functions import text as tx
from policyspark.functions import truth as tr
from policyspark.functions.shared import settled
from policyspark.operators import policy
from policyspark.operators.compiler import CHILDREN, DEEPEST, KINDS, MOST_CONDITIONS, NODES, RULE, bound, compiled, leaves_of, parts_of, quoted
from policyspark.operators.model import ModelFn

VERDICTS = ("ENTAILED", "CONTRADICTED", "UNSUPPORTED", "AMBIGUOUS")
RELEVANCES = ("RELEVANT", "NOT_RELEVANT", "NEEDS_CONTEXT")
COVERAGES = ("COMPLETE", "MISSING_RULES", "NO_RULES_NEEDED", "NEEDS_CONTEXT")
# Words of an error that no second question mends, words that reject an answer, how comparisons are read out.
LIMITS = ("context limit", "budget", "output limit", "output token limit", "truncated", "invalid json")
SKIPS = ("context limit", "budget", "output limit", "truncated")
REJECTS = ("invalid json", "schema", "plan")
PHRASES = {"eq": "EQUALS", "neq": "DOES NOT EQUAL", "lt": "IS LESS THAN", "lteq": "IS AT MOST", "gt": "IS GREATER THAN", "gteq": "IS AT LEAST", "isAnyOf": "IS ONE OF", "isNoneOf": "IS NONE OF", "isAllOf": "IS ALL OF"}


# ---- what a plan may look like


def rule_cap(text: Column) -> Column:
    """How many rules a clause may plan: two more than its modal verbs, within 2 and 12."""
    return F.greatest(F.lit(2), F.least(F.lit(12), 2 + F.size(F.regexp_extract_all(text, F.lit(r"(?i)\b(shall|must|may)\b"), F.lit(1)))))


def forced_kind(text: Column) -> Column:
    """The only kind a clause can have, where it has one modal verb: may, must not, must or shall."""
    modals = F.regexp_extract_all(text, F.lit(r"(?i)\b((?:shall|must|may) not|shall|must|may)\b"), F.lit(1))
    one = F.lower(F.get(modals, F.lit(0)))
    only = text.rlike(r"(?i)\bonly\b")
    return F.when((F.size(modals) == 1) & ~only, F.when(one == "may", "permission").when(one.endswith("not"), "prohibition").otherwise("obligation"))


def plan_schema(cap: int, evidence: list[str], kind: str | None = None) -> dict:
    """The form of a plan for one clause, as a JSON schema; `compiler.planned` checks the same."""
    leaf = {"type": "object", "required": ["field", "op"], "properties": {"field": {"type": "string"}, "op": {"enum": list(policy.OPERATORS)}, "value": {}, "parameter": {"type": "string"}}, "oneOf": [{"required": ["value"]}, {"required": ["parameter"]}]}
    level = leaf
    for _ in range(DEEPEST):
        level = {"oneOf": [leaf, *({"type": "object", "required": [g], "properties": {g: {"type": "array", "items": level, "minItems": CHILDREN[0], "maxItems": CHILDREN[1]}}} for g in ("all", "any", "exactly_one"))]}
    conditions = {"type": "array", "items": level, "maxItems": MOST_CONDITIONS}
    rule = {"type": "object", "required": ["kind", "actor", "action", "asset", "evidence"], "properties": {"kind": {"enum": [kind] if kind else list(KINDS)}, "actor": {"type": "string"}, "action": {"type": "string", "pattern": "^[a-z][A-Za-z]*$"}, "asset": {}, "evidence": {"type": "string"}, "source": {"enum": evidence}, "conditions": conditions, "allowed_when": conditions, "group": {"type": "string"}}}
    return {"type": "object", "required": ["rules"], "properties": {"rules": {"type": "array", "items": rule, "maxItems": cap}, "parameters": {"type": "array"}, "unrepresented": {"type": "array", "items": {"type": "string"}}, "reason": {"type": "string"}}}


def error_outcome(error: Column) -> Column:
    """What becomes of a clause after an error: skipped (budgets, limits), rejected (form), else failed; null without one."""
    return F.when(error.isNull(), None).when(has(error, SKIPS), "skipped").when(has(error, REJECTS), "rejected").otherwise("failed")


# ---- rules as they are read


def nodes_of(conditions: Column) -> Column:
    """Conditions (JSON texts) as typed nodes."""
    return F.from_json(F.concat(F.lit("["), F.array_join(conditions, ","), F.lit("]")), NODES)


def worded(c: Column, labels: Column, depth: int = DEEPEST) -> Column:
    """A condition in fixed words. labels: a map from a parameter to what it is called."""
    value = F.to_json(c["value"])
    right = F.when(c["parameter"].isNotNull(), F.concat(F.coalesce(F.try_element_at(labels, c["parameter"]), c["parameter"]), F.lit(" [UNRESOLVED]"))).otherwise(value)
    one = F.concat_ws(" ", c["field"], policy.worded(PHRASES, c["op"]), right)
    if depth == 0:
        return one
    joint = F.when(c["all"].isNotNull(), " AND ").when(c["any"].isNotNull(), " OR ").otherwise(" XOR ")
    return F.when(parts_of(c).isNull(), one).otherwise(F.concat(F.lit("("), joined_by(F.transform(parts_of(c), lambda x: worded(x, labels, depth - 1)), joint), F.lit(")")))


def joined_by(parts: Column, joint: Column) -> Column:
    """Texts joined by a text that is a column."""
    return F.aggregate(F.slice(parts, 2, 1000), F.element_at(parts, 1), lambda done, x: F.concat(done, joint, x))


def meaning(kind: Column, actor: Column, action: Column, asset: Column, conditions: Column, labels: Column | None = None) -> Column:
    """A rule's encoded meaning in fixed words, what it leaves open said too. conditions: JSON texts."""
    labels = F.create_map().cast("map<string,string>") if labels is None else labels

    def told(nodes: Column) -> Column:
        fields = F.transform(F.flatten(F.transform(nodes, lambda c: leaves_of(c))), lambda x: F.lower(x["field"]))
        silent = F.array(*[F.when(~F.arrays_overlap(fields, F.array(*map(F.lit, own))), label) for label, own in (("recipient", ("recipient",)), ("price", ("payamount", "cost", "price", "fee")), ("time limit", ("elapsedtime",)))])
        held = F.coalesce(F.nullif(F.array_join(F.transform(nodes, lambda c: worded(c, labels)), " AND "), F.lit("")), F.lit("always"))
        open_ = F.array_join(F.filter(silent, lambda x: x.isNotNull()), ", ")
        return F.concat(F.concat_ws(" | ", F.concat(F.upper(kind), F.lit(": "), actor), action, asset, held), F.when(open_ != "", F.concat(F.lit(" | says nothing of "), open_)).otherwise(""))

    return bound(nodes_of(conditions), told)


def node_truth(c: Column, state: Column, depth: int = DEEPEST) -> Column:
    """TRUE, FALSE or NULL of a condition over a state (a map from field to JSON text)."""
    one = bound(F.struct(c["field"].alias("field"), c["op"].alias("op"), F.to_json(c["value"]).alias("right")), lambda x: tr.leaf(x["field"], x["op"], F.try_element_at(state, x["field"]), x["right"]))
    if depth == 0:
        return one
    parts = F.transform(parts_of(c), lambda x: node_truth(x, state, depth - 1))
    joined = bound(parts, lambda p: F.when(c["all"].isNotNull(), F.forall(p, lambda x: x)).when(c["any"].isNotNull(), F.exists(p, lambda x: x)).otherwise(F.when(F.size(F.filter(p, lambda x: x)) > 1, False).when(F.exists(p, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(F.size(F.filter(p, lambda x: x)) == 1)))
    return F.when(parts_of(c).isNull(), one).otherwise(joined)


def examples(rules: DataFrame) -> DataFrame:
    """rules with state (a map from field to JSON text) and applies: whether a prohibition by purpose then holds.

    A row each of the first two purposes and approvals a rule names and some other value of each,
    nine at most; other fields have the values they are compared with. rules: kind, conditions (JSON texts).
    """
    rows = rules.where("kind = 'prohibition'").withColumn("nodes", nodes_of(F.col("conditions")))
    rows = rows.withColumn("leaves", F.flatten(F.transform("nodes", lambda c: leaves_of(c))))
    values = lambda x: F.coalesce(tr.members(F.when(x["value"].startswith("["), x["value"])), F.array(x["value"]))
    named = lambda field: F.array_distinct(F.flatten(F.transform(F.filter("leaves", lambda x: (x["field"] == field) & x["value"].isNotNull()), values)))
    tried = lambda field: F.when(F.size(named(field)) > 0, F.concat(F.slice(named(field), 1, 2), F.array(F.lit('"some other value"')))).otherwise(F.array(F.lit(None).cast("string")))
    fixed = F.filter("leaves", lambda x: ~x["field"].isin("purpose", "approval") & (x["op"] == "eq") & x["value"].isNotNull())
    first = F.aggregate(fixed, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["field"]), m).otherwise(F.map_concat(m, F.create_map(x["field"], x["value"]))))
    rows = rows.where(F.size(named("purpose")) > 0).withColumn("purpose", F.explode(tried("purpose"))).withColumn("approval", F.explode(tried("approval")))
    varied = F.map_filter(F.create_map(F.lit("purpose"), "purpose", F.lit("approval"), "approval"), lambda k, v: v.isNotNull())
    rows = rows.withColumn("state", F.map_concat(first, varied))
    told = rows.withColumn("applies", F.forall(F.transform("nodes", lambda c: node_truth(c, F.col("state"))), lambda x: x))
    return told.where("applies is not null").drop("nodes", "leaves", "purpose", "approval")


# ---- the models by rule of thumb; real ones have the same form

SENTENCE = re.compile(r"\b(Provider|Recipient) (must not|must only|must|may) ([a-z]+) (?:the )?([A-Z][a-z]+)")


def rule_planner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Plans of the first sentence of the form `Provider|Recipient modal verb Asset`."""
    for batch in batches:
        answers = []
        for value in batch["value_json"]:
            text = json.loads(value)["text"]
            m, rules = SENTENCE.search(text), []
            if m:
                one = {"actor": m[1], "action": m[3], "asset": m[4], "evidence": m[0], "kind": {"must not": "prohibition", "must only": "restriction", "must": "obligation", "may": "permission"}[m[2]], "conditions": []}
                if m[2] == "must only":
                    one["allowed_when"] = [{"field": "scope", "op": "eq", "value": text[m.end() :].strip(" .")}]
                if t := re.search(r"\b(within|[Oo]nce) (\d+) (day|hour)s?\b", text):
                    one["conditions"] += [{"field": "elapsedTime", "op": "lteq" if t[1] == "within" else "gteq", "value": f"P{t[2]}D" if t[3] == "day" else f"PT{t[2]}H"}, {"field": "event", "op": "eq", "value": "source event"}]
                if "free of charge" in text:
                    one["conditions"].append({"field": "payAmount", "op": "eq", "value": 0})
                rules.append(one)
            answers.append(json.dumps({"rules": rules, "reason": "" if rules else "no operative sentence"}))
        yield pd.DataFrame({"request_id": batch["request_id"], "answer_json": answers, "error": [None] * len(batch)})


def rule_reviewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts: a discretion that a rule leaves out makes it UNSUPPORTED, else it is ENTAILED; rules cover their clause, and a clause without any needs none."""
    for batch in batches:
        answers = []
        for value in batch["value_json"]:
            v = json.loads(value)
            told = ["UNSUPPORTED" if "as it sees fit" in v["text"] and not any(c.get("field") == "discretion" for c in r["conditions"]) else "ENTAILED" for r in v["rules"]]
            answers.append(json.dumps({"relevance": "RELEVANT", "coverage": "COMPLETE" if told else "NO_RULES_NEEDED", "reason": "read by rule of thumb", "verdicts": told, "missing": []}))
        yield pd.DataFrame({"request_id": batch["request_id"], "answer_json": answers, "error": [None] * len(batch)})


# ---- asking


def asked(rows: DataFrame, model: ModelFn) -> DataFrame:
    """(contract_id, ord, answer_json, error) of rows (contract_id, ord, value_json): each asked once, what isn't answered is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame({"request_id": [f"{c}/{o}" for c, o in zip(batch["contract_id"], batch["ord"], strict=True)], "value_json": batch["value_json"]})
            got: dict[str, tuple[str | None, str | None]] = {}
            for answers in model(iter([frame])):
                for request, answer, error in zip(answers["request_id"], answers["answer_json"], answers["error"], strict=True):
                    got[request] = (answer if isinstance(answer, str) else None, str(error) if isinstance(error, str) else None)
            told = [got.get(r, (None, "no answer")) for r in frame["request_id"]]
            yield pd.DataFrame({"contract_id": batch["contract_id"], "ord": batch["ord"], "answer_json": [a for a, _ in told], "error": [e for _, e in told]})

    return rows.select("contract_id", "ord", "value_json").mapInPandas(run, "contract_id string, ord int, answer_json string, error string")


REVIEW = "struct<relevance:string,coverage:string,reason:string,verdicts:array<string>,missing:array<struct<requirement:string,quote:string>>>"
KEYS = ["contract_id", "ord"]


def review_faults(r: Column, n: Column, text: Column) -> Column:
    """Why a review of n rules of a clause can't be used: its form, verdicts that don't fit the rules, coverage that contradicts them, quotes from elsewhere."""
    verdicts, missing = F.coalesce(r["verdicts"], F.array().cast("array<string>")), F.coalesce(r["missing"], F.array().cast("array<struct<requirement:string,quote:string>>"))
    cover, relevance = r["coverage"], r["relevance"]
    faults = F.array(
        F.when(~F.coalesce(relevance.isin(*RELEVANCES) & cover.isin(*COVERAGES), F.lit(False)), "a review has a relevance and a coverage"),
        F.when((F.size(verdicts) != n) | F.exists(verdicts, lambda v: ~F.coalesce(v.isin(*VERDICTS), F.lit(False))), "every rule has one verdict"),
        F.when(F.exists(missing, lambda m: ~F.coalesce((F.trim(m["quote"]) != "") & F.contains(tx.folded(text), tx.folded(m["quote"])), F.lit(False))), "a missing rule is quoted from the clause itself"),
        F.when((cover == "COMPLETE") & (n == 0), "no rule can be complete"),
        F.when((F.size(missing) > 0) != (cover == "MISSING_RULES"), "missing rules are listed where some are missing"),
        F.when((cover == "NO_RULES_NEEDED") & F.array_contains(verdicts, "ENTAILED"), "a rule that holds is needed"),
        F.when((relevance == "NOT_RELEVANT") & cover.isin("COMPLETE", "MISSING_RULES"), "what isn't relevant has no rules"),
    )
    return F.filter(faults, lambda x: x.isNotNull())


def reviewed(rows: DataFrame, reviewer: ModelFn, resolved: Column | None = None, attempt: int = 1) -> DataFrame:
    """(contract_id, ord, relevance, coverage, verdicts, missing, review_reason, review_error) of rows (contract_id, ord, text, texts, rules).

    An answer that can't be used is asked for once more, unless a limit was reached; then all
    verdicts are AMBIGUOUS and the context is wanting. resolved: whether all references of the clause
    are; without that nothing is complete.
    """
    given = F.transform("rules", lambda r: F.struct(r["kind"].alias("kind"), r["role"].alias("role"), r["actor"].alias("actor"), r["action"].alias("action"), r["asset"].alias("asset"), F.try_parse_json(F.concat(F.lit("["), F.array_join(r["conditions"], ","), F.lit("]"))).alias("conditions"), meaning(r["kind"], r["actor"], r["action"], r["asset"], r["conditions"]).alias("meaning")))
    whole = rows.withColumn("resolved", F.lit(True) if resolved is None else resolved)
    open_, told = settled(whole.select(*KEYS, "text", "resolved", F.size("rules").alias("n"), F.to_json(F.struct("text", F.col("texts").alias("context"), given.alias("rules"), F.lit(attempt).alias("attempt"))).alias("value_json"))), []
    for last in (False, True):
        answers = asked(open_, reviewer)
        answers = settled(open_.join(answers, KEYS).withColumn("r", F.from_json("answer_json", REVIEW)).withColumn("faults", F.when(F.col("error").isNotNull(), F.array("error")).when(F.try_parse_json("answer_json").isNull(), F.array(F.lit("invalid JSON"))).otherwise(review_faults(F.col("r"), F.col("n"), F.col("text")))))
        done = (F.size("faults") == 0) | has(F.array_join("faults", "; "), SKIPS) | F.lit(last)
        told.append(answers.where(done))
        open_ = answers.where(~done).select(open_.columns)
    out = told[0].unionByName(told[1])
    bad, wants = F.size("faults") > 0, (F.col("r.relevance") == "NEEDS_CONTEXT") | (~F.col("resolved") & F.col("r.coverage").isin("COMPLETE", "NO_RULES_NEEDED"))
    return out.select(
        *KEYS, F.when(bad, "NEEDS_CONTEXT").otherwise(F.col("r.relevance")).alias("relevance"), F.when(bad | wants, "NEEDS_CONTEXT").otherwise(F.col("r.coverage")).alias("coverage"),
        F.when(bad, F.array_repeat(F.lit("AMBIGUOUS"), F.col("n"))).otherwise(F.col("r.verdicts")).alias("verdicts"),
        F.when(bad | (F.col("r.relevance") == "NEEDS_CONTEXT"), F.array().cast("array<string>")).otherwise(F.transform("r.missing", lambda m: F.coalesce(m["requirement"], m["quote"]))).alias("missing"),
        F.when(~bad, F.col("r.reason")).alias("review_reason"), F.when(bad, summary(F.col("faults"))).alias("review_error"),
    )


def has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of some words."""
    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, words))), F.lit(False))


def summary(faults: Column, most: int = 500) -> Column:
    """Faults as one feedback text: each once, cut at `most` characters."""
    return F.substring(F.array_join(F.array_distinct(faults), "; "), 1, most)


# ---- states

def transition(attempt: int) -> Column:
    """What becomes of a clause after an attempt: struct(outcome, rules, reason, withheld, kept, feedback). No outcome: it is asked again.

    Columns: error (of the model), form, rules, refused, why, unrepresented, reason, coverage, verdicts,
    missing, review_reason, review_error, kept (the best rules of the attempt before, or null).
    """
    last, none = attempt > 1, F.lit(None).cast(RULE)
    rules, kept = F.col("rules"), F.col("kept")
    fragment, refused, left_out = F.size("rules") > 0, F.size("refused") > 0, F.col("unrepresented") > 0
    sound = F.col("review_error").isNull()
    entailed = sound & F.forall("verdicts", lambda v: v == "ENTAILED")
    fallen = F.transform(F.filter(F.arrays_zip(rules.alias("rules"), F.col("verdicts")), lambda z: z["verdicts"] != "ENTAILED"), lambda z: z["rules"]["group"])
    supported = F.when(sound, F.filter(rules, lambda r: ~F.array_contains(fallen, r["group"])))
    saved = F.coalesce(F.size(supported), F.lit(0)) > 0
    complete = F.col("coverage") == F.when(fragment, "COMPLETE").otherwise("NO_RULES_NEEDED")
    partly = entailed & fragment & (F.col("coverage").isin("MISSING_RULES", "NEEDS_CONTEXT") | left_out | refused)
    limit = has(F.col("error"), LIMITS) | F.array_contains("form", "answer is not JSON")
    broken = F.col("error").isNotNull() | (F.size("form") > 0)
    empty = ~broken & ~fragment & refused
    unlike = F.transform(F.filter("verdicts", lambda v: v != "ENTAILED"), F.lower)
    issues = F.concat(F.coalesce("why", F.array().cast("array<string>")), unlike, F.transform("missing", lambda m: F.concat(F.lit("missing: "), m)), F.when(F.col("review_error").isNotNull(), F.array(F.col("review_error"))).otherwise(F.array().cast("array<string>")), F.when(left_out, F.array(F.lit("words are unrepresented"))).otherwise(F.array().cast("array<string>")), F.when(~complete, F.array(F.concat(F.lit("coverage: "), F.col("coverage")))).otherwise(F.array().cast("array<string>")))
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(broken, summary(F.col("form"))).otherwise(summary(issues))
    unresolved = lambda rs: F.exists(rs, lambda r: r["unresolved"])

    def state(outcome: str | None, rs: Column = none, reason: Column | str | None = None, keep: Column = none) -> Column:
        named = F.lit(outcome).cast("string") if outcome != "generated" else F.when(unresolved(rs), "partial_needs_review").otherwise("generated")
        groups = F.size(F.array_distinct(F.concat(F.coalesce("refused", F.array().cast("array<string>")), F.transform(F.filter(F.coalesce(rules, F.array().cast(RULE)), lambda r: ~F.coalesce(F.exists(rs, lambda s: s["group"] == r["group"]), F.lit(False))), lambda r: r["group"]))))
        why = F.lit(reason).cast("string") if not isinstance(reason, Column) else reason
        return F.struct(named.alias("outcome"), rs.alias("rules"), why.alias("reason"), groups.alias("withheld"), keep.alias("kept"), wrong.alias("feedback"))

    again = state(None)
    failed = F.when(kept.isNotNull(), state("partial_needs_review", kept, F.concat(F.lit("repair failed: "), wrong))).otherwise(state("rejected", none, wrong)) if last else again
    told = F.coalesce("reason", "review_reason")
    return (
        F.when(limit, F.when(kept.isNotNull(), state("partial_needs_review", kept, wrong)).otherwise(state("rejected", none, F.concat(F.lit("skipped: "), wrong))))
        .when(broken | empty, failed)
        .when(~fragment & entailed & (F.col("coverage") == "NO_RULES_NEEDED"), state("abstained_needs_review", none, told))
        .when(entailed & complete & ~left_out & ~refused, state("generated", rules, told))
        .when(partly & F.lit(last), state("partial_needs_review", rules, wrong))
        .when(saved, state("partial_needs_review", supported, wrong) if last else state(None, keep=supported))
        .when(~fragment & sound & (F.col("coverage") == "NEEDS_CONTEXT") & F.lit(last), state("abstained_needs_review", none, wrong))
        .otherwise(failed)
    )


def attempted(items: DataFrame, planner: ModelFn, reviewer: ModelFn, attempt: int) -> DataFrame:
    """items (contract_id, ord, text, texts, ids, cap, kind, feedback, kept) with the state an attempt leaves them in."""
    value = F.to_json(F.struct("text", F.col("texts").alias("context"), F.coalesce("feedback", F.lit("")).alias("feedback")))
    answers = settled(asked(items.withColumn("value_json", value), planner))
    both = items.join(answers, KEYS)
    made = settled(both.select(*KEYS, "text", "texts", "kept", "error").join(compiled(both), KEYS))
    live = (F.col("error").isNull()) & (F.size("form") == 0) & ((F.size("rules") > 0) | (F.size("refused") == 0))
    read = reviewed(made.where(live), reviewer, attempt=attempt)
    nothing = F.array().cast("array<string>")
    whole = made.join(read, KEYS, "left").withColumns({"verdicts": F.coalesce("verdicts", nothing), "missing": F.coalesce("missing", nothing), "coverage": F.coalesce("coverage", F.lit("NEEDS_CONTEXT"))})
    return settled(whole.select(*KEYS, F.lit(attempt).alias("attempts"), transition(attempt).alias("s")).select(*KEYS, "attempts", "s.*"))


def gate() -> Column:
    """Why a clause can have no rule, where its wording alone says so."""
    t = F.col("text")
    return F.when(tx.standalone_heading(F.col("heading"), t), "heading").when(tx.explanatory_faq(t), "explanatory questions").when(tx.definition_only(t), "definition").when(tx.ownership_declaration(t), "ownership")


def generate(clauses: DataFrame, evidence: DataFrame | None = None, planner: ModelFn = rule_planner, reviewer: ModelFn = rule_reviewer) -> DataFrame:
    """contract_id, ord, clause_id, outcome, reason, attempts, withheld (groups), rules (`compiler.RULE`) of each clause (contract_id, ord, clause_id, heading, text).

    evidence: (contract_id, ord, target_ord, context: text). Gated clauses abstain unasked. A plan that
    is malformed, refused or not entailed is asked for once more with what was wrong; the groups that
    were entailed as a whole are kept, and stay if the second attempt brings none.
    """
    rows = clauses.select("contract_id", F.col("ord").cast("int").alias("ord"), "clause_id", "heading", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", gate().alias("gate"), rule_cap(F.col("text")).alias("cap"), forced_kind(F.col("text")).alias("kind"))
    own = F.array(F.col("ord").cast("string"))
    if evidence is not None:
        held = evidence.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("target_ord", "context"))).alias("ev"))
        rows = rows.join(held, KEYS, "left").withColumns({"ids": F.concat(own, F.coalesce(F.transform("ev", lambda x: x["target_ord"].cast("string")), F.array().cast("array<string>"))), "texts": F.coalesce(F.transform("ev", lambda x: x["context"]), F.array().cast("array<string>"))}).drop("ev")
    else:
        rows = rows.withColumns({"ids": own, "texts": F.array().cast("array<string>")})
    items = settled(rows)
    none = F.lit(None).cast(RULE)
    state = F.lit(None).cast("string")
    open_, done = items.where("gate is null").withColumns({"feedback": state, "kept": none}), []
    for attempt in (1, 2):
        after = attempted(open_, planner, reviewer, attempt)
        done.append(after.where("outcome is not null").drop("kept", "feedback"))
        if attempt == 1:
            open_ = items.join(after.where("outcome is null").select(*KEYS, "feedback", "kept"), KEYS)
    gated = items.where("gate is not null").select(*KEYS, F.lit(0).alias("attempts"), F.lit("abstained_needs_review").alias("outcome"), none.alias("rules"), F.col("gate").alias("reason"), F.lit(0).alias("withheld"))
    told = gated.unionByName(done[0]).unionByName(done[1])
    return items.select(*KEYS, "clause_id").join(told, KEYS).select("contract_id", "ord", "clause_id", "outcome", "reason", "attempts", "withheld", F.coalesce("rules", F.array().cast(RULE)).alias("rules"))


WITH_RULES = ("generated", "partial_needs_review")


def policy_rules(outcomes: DataFrame) -> DataFrame:
    """All rules of the clauses that have any under numbers of their agreement, in source order: contract_id, rule_id, n, ord, clause_id, kind, actor, action, asset, issuer, evidence, group_id, conditions, requires, remedies (JSON texts).

    Duties and remedies stay in their rule; clauses that were rejected or abstained give none.
    """
    rows = outcomes.where(F.col("outcome").isin(*WITH_RULES))
    beside = lambda role: F.filter("rules", lambda x: (x["role"] == role) & (x["n"] == F.col("r.n")) & (x["spot"] == F.col("r.spot")))
    one = lambda x: F.concat(F.lit('{"actor":'), quoted(x["actor"]), F.lit(',"action":'), quoted(x["action"]), F.lit(',"asset":'), quoted(x["asset"]), F.lit(',"conditions":['), F.array_join(x["conditions"], ","), F.lit("]}"))
    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    rows = rows.select("contract_id", "ord", "clause_id", "rules", F.explode(F.filter("rules", lambda r: r["role"] == "rule")).alias("r"))
    number = F.row_number().over(Window.partitionBy("contract_id").orderBy("ord", "r.n", "r.spot"))
    rows = rows.withColumns({"requires": listed(F.transform(beside("duty"), one)), "remedies": listed(F.transform(beside("remedy"), one)), "number": number})
    return rows.select("contract_id", F.concat(F.lit("urn:"), "contract_id", F.lit(":r"), F.col("number").cast("string")).alias("rule_id"), F.col("number").alias("n"), "ord", "clause_id", "r.kind", "r.actor", "r.action", "r.asset", "r.issuer", "r.evidence", F.concat_ws("/", F.col("ord").cast("string"), "r.group").alias("group_id"), listed(F.col("r.conditions")).alias("conditions"), "requires", "remedies")


def policies(outcomes: DataFrame, submitted: DataFrame | None = None) -> DataFrame:
    """A row per agreement: clauses and rules, outcomes by kind, status, the warning that nothing came of many clauses, coverage of what was submitted."""
    n = lambda o: F.sum((F.col("outcome") == o).cast("int")).alias(o)
    own = F.when(F.col("outcome").isin(*WITH_RULES), F.size(F.filter("rules", lambda r: r["role"] == "rule"))).otherwise(0)
    each = outcomes.groupBy("contract_id").agg(F.count("*").alias("submitted"), F.sum(own).alias("rules"), n("generated"), n("partial_needs_review"), n("abstained_needs_review"), n("rejected"), F.sort_array(F.collect_set("outcome")).alias("outcomes"))
    traced = F.col("generated") + F.col("partial_needs_review")
    out = each.select("contract_id", "submitted", "rules", "generated", "partial_needs_review", "abstained_needs_review", "rejected", policy.status(F.col("outcomes"), traced).alias("status"), ((F.col("abstained_needs_review") >= 5) & (F.col("rules") == 0)).alias("zero_yield"))
    return out if submitted is None else out.join(coverage(submitted, outcomes).drop("submitted"), "contract_id", "left")


def coverage(sources: DataFrame, submitted: DataFrame) -> DataFrame:
    """(contract_id, total, submitted, not_submitted): source clauses, how many went into generation and which did not."""
    sent = submitted.select("contract_id", "ord", F.lit(True).alias("sent")).distinct()
    both = sources.select("contract_id", "ord").join(sent, ["contract_id", "ord"], "left")
    return both.groupBy("contract_id").agg(F.count("*").alias("total"), F.count("sent").alias("submitted"), F.sort_array(F.collect_list(F.when(F.col("sent").isNull(), F.col("ord")))).alias("not_submitted"))


def review(rules: DataFrame, clauses: DataFrame, reviewer: ModelFn = rule_reviewer) -> DataFrame:
    """(contract_id, rule_id, group_id, verdict, coverage, relevance): each clause's rules judged against its text. rules: as policy_rules gives them."""
    conditions = F.transform(F.from_json("conditions", "array<variant>"), lambda c: F.to_json(c))
    none = F.lit(None).cast("string")
    one = F.struct("n", F.lit(0).alias("spot"), F.lit(0).alias("seat"), F.lit("rule").alias("role"), F.col("group_id").alias("group"), "kind", "actor", none.alias("party"), none.alias("issuer"), "action", "asset", "evidence", conditions.alias("conditions"), F.lit(False).alias("unresolved"), "rule_id")
    rows = rules.groupBy(*KEYS).agg(F.sort_array(F.collect_list(one)).alias("all")).join(clauses.select("contract_id", F.col("ord").cast("int").alias("ord"), F.coalesce("text", F.lit("")).alias("text")), KEYS)
    rows = settled(rows.select(*KEYS, "text", F.array().cast("array<string>").alias("texts"), "all", F.transform("all", lambda r: r.dropFields("rule_id")).cast(RULE).alias("rules")))
    both = rows.join(reviewed(rows, reviewer), KEYS).select("contract_id", "coverage", "relevance", F.explode(F.arrays_zip("all", "verdicts")).alias("z"))
    return both.select("contract_id", "z.all.rule_id", F.col("z.all.group").alias("group_id"), F.col("z.verdicts").alias("verdict"), "coverage", "relevance")


def example_assets(rules: DataFrame) -> DataFrame:
    """(contract_id, clause_id, asset, general): assets that a clause only gives as examples of another asset it has a like rule for (`X such as Y`, `X including Y`)."""
    a = rules.select("contract_id", "clause_id", "ord", "kind", "actor", "action", "asset", "text")
    b = a.select("contract_id", "clause_id", "ord", "kind", "actor", "action", F.col("asset").alias("general"))
    low = F.regexp_replace(F.lower("text"), r"\s+", " ")
    named = lambda w: F.contains(low, F.concat(F.lower("general"), F.lit(w), F.lower("asset")))
    return a.join(b, ["contract_id", "clause_id", "ord", "kind", "actor", "action"]).where((F.col("asset") != F.col("general")) & (named(" such as ") | named(" including ") | named(", such as ") | named(", including "))).select("contract_id", "clause_id", "asset", "general")


def counters(metrics: DataFrame) -> DataFrame:
    """Totals of a run by worker: requests, failures, tokens in and out, seconds, tokens a second. metrics: a row a request."""
    out = metrics.groupBy("worker").agg(F.count("*").alias("requests"), F.sum(F.col("error").isNotNull().cast("int")).alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("seconds").alias("seconds"))
    return out.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.col("tokens_out") / F.col("seconds")))
