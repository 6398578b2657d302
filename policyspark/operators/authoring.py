"""Terms of a template agreement: their checks, the document they make, what is frozen of it, probes of its rules."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions import text as tx
from policyspark.functions import truth as tr

# What terms consist of, their bounds, names that are taken, countries data may stay in.
LABELS = "title provider recipient data purpose platform records background results work_plan authorized_users documentation certificate".split()
NUMBERS = {"delete_days": 3650, "notify_hours": 168, "publication_notice_days": 365, "publication_delay_days": 3650, "delivery_days": 365, "certificate_days": 365, "error_hours": 168}
DATES = ("project_start", "project_end")
TAKEN = ("provider", "recipient", "data", "incident", "parties", "permitted purpose", "platform", "records", "background", "results", "work plan", "security requirements", "confidential information", "authorized users", "documentation", "certificate", "error")
COUNTRIES = ("Norway", "Sweden", "Denmark", "Finland", "Iceland", "Germany", "France", "Netherlands")
MODIFIERS = ("consent_exception", "legal_disclosure", "legal_retention")
ASSETS = {"data": (), "platform": ("platform_access",), "records": ("records_access",), "background": ("background_access",), "results": ("publication", "attribution"), "documentation": ("provider_delivery", "error_reporting"), "certificate": ("deletion_certificate",)}
CLAUSE_LIKE = r"(?i)\b(?:Provider|Recipient|Parties)\s+(?:shall|must|may|will|can)\b"
RULE_LIKE = r"(?i)\b(?:shall|must|may|will)\b"


def term_faults(flags: list[str]) -> Column:
    """Everything wrong with a row of terms, as an array of texts: labels, flags, bounds, dates, countries, names that clash.

    Columns: LABELS, data_description, `flags` as booleans, NUMBERS as integers, DATES as texts,
    storage_countries as an array. A null is never valid.
    """
    folded = lambda c: tx.folded(F.col(c))
    on = lambda names: F.coalesce(F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0]), F.lit(False)) if names else F.lit(True)
    faults = []
    for k in LABELS:
        c = F.col(k)
        faults.append(F.when(c.isNull() | ~F.length(tx.stripped(c)).between(1, 120) | c.rlike(r"[\x00-\x1f]"), f"{k} is not one line of 1 to 120 characters").when(c.rlike(CLAUSE_LIKE), f"{k} is a clause, not a label").when(F.lit(k != "title") & folded(k).isin(*TAKEN), f"{k} repeats a role"))
    d = F.col("data_description")
    faults.append(F.when(d.isNull() | (F.length(d) > 600) | d.rlike(r"[\x00-\x1f]") | d.rlike(RULE_LIKE), "data_description is no plain line"))
    faults += [F.when(F.col(k).isNull(), f"{k} is not true or false") for k in flags]
    s = F.col("storage_countries")
    faults.append(F.when(s.isNull() | ~F.size(s).between(1, 4) | (F.size(F.array_distinct(s)) != F.size(s)) | (F.size(F.array_except(s, F.array(*map(F.lit, COUNTRIES)))) > 0), "storage_countries are not 1 to 4 known countries"))
    faults += [F.when(F.col(k).isNull() | ~F.col(k).between(1, most), f"{k} is not 1 to {most}") for k, most in NUMBERS.items()]
    bad = {k: tx.date_ordinal(F.col(k)).isNull() for k in DATES}
    faults += [F.when(bad[k], f"{k} is not a date") for k in DATES]
    faults.append(F.when(~bad[DATES[0]] & ~bad[DATES[1]] & (F.col(DATES[1]) < F.col(DATES[0])), "project_end is before project_start"))
    active = F.array_compact(F.array(*[F.when(on(names), folded(k)) for k, names in ASSETS.items()]))
    faults.append(F.when(F.size(F.array_distinct(active)) != F.size(active), "resources share a name"))
    faults.append(F.when(folded("provider") == folded("recipient"), "the parties are one"))
    faults.append(F.when(on(["authorized_access"]) & folded("authorized_users").isin(F.lit("")) | on(["authorized_access"]) & ((folded("authorized_users") == folded("provider")) | (folded("authorized_users") == folded("recipient"))), "authorized_users are a party"))
    faults.append(F.when(~on([k for k in flags if k not in MODIFIERS]), "no term is selected"))
    return F.array_compact(F.array(*faults))


def with_defaults(terms: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Terms saved in an earlier shape, with the fields that came later at their defaults. Fields that are unknown raise."""
    unknown = set(terms.columns) - set(defaults) - {"contract_id"}
    if unknown:
        raise ValueError(f"unknown terms: {', '.join(sorted(unknown))}")
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return terms.select("contract_id", *[F.col(k) if k in terms.columns else lit(v).alias(k) for k, v in defaults.items()])


def checked(terms: DataFrame, flags: list[str]) -> DataFrame:
    """Terms with white space of their labels made single; ValueError names the first faults."""
    found = terms.select("contract_id", F.explode(term_faults(flags)).alias("fault")).orderBy("contract_id", "fault").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.contract_id}: {r.fault}" for r in found))
    return terms.withColumns({k: F.regexp_replace(tx.stripped(F.col(k)), r"\s+", " ") for k in (*LABELS, "data_description")})


def frozen(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """(contract_id, clauses, rules, text_sha, rules_sha): what an authored agreement is held to. Texts in order, rules by their signature."""
    texts = clauses.groupBy("contract_id").agg(F.count("*").alias("clauses"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.md5("text").alias("t")))), lambda x: x["t"]), ","), 256).alias("text_sha"))
    signed = rules.groupBy("contract_id").agg(F.count("*").alias("rules"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.md5("signature"))), ","), 256).alias("rules_sha"))
    return texts.join(signed, "contract_id", "left").select("contract_id", "clauses", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"), "text_sha", "rules_sha")


def drifted(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(contract_id, problem) where an agreement is no longer what its manifest froze."""
    both = manifest.select("contract_id", *[F.col(c).alias(f"_{c}") for c in ("clauses", "rules", "text_sha", "rules_sha")]).join(now, "contract_id", "left")
    problem = F.when(F.col("text_sha").isNull(), "agreement is gone").when(F.col("text_sha") != F.col("_text_sha"), "text changed").when(~F.col("rules_sha").eqNullSafe(F.col("_rules_sha")), "rules changed")
    return both.select("contract_id", problem.alias("problem")).where("problem is not null")


def load(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """now, if nothing drifted; ValueError otherwise."""
    found = drifted(now, manifest).orderBy("contract_id").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.contract_id}: {r.problem}" for r in found))
    return now


@dataclass(frozen=True)
class Probe:
    """A state of the world and whether a rule's conditions then hold. state and value texts may have placeholders."""

    clause: str
    scenario: str
    state: tuple[tuple[str, str], ...]
    expected: bool
    needs: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


def probed(truth: Column, kind: Column, expected: Column) -> Column:
    """Whether a probe passed: an unknown outcome never does."""
    return F.coalesce(truth == expected, F.lit(False))


def truth_over(conditions: Column, state: Column) -> Column:
    """Truth of an array of struct(field, op, value) over a map of JSON texts: Kleene's conjunction, unknown where the state is silent."""
    each = F.transform(conditions, lambda c: tr.leaf(c["field"], c["op"], F.try_element_at(state, c["field"]), c["value"]))
    return F.when(F.exists(each, lambda t: F.coalesce(~t, F.lit(False))), False).when(F.exists(each, lambda t: t.isNull()), F.lit(None).cast("boolean")).otherwise(True)


def sha(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
