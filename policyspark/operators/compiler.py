"""Rule plans to rules, as columns: what a plan must look like, what its rules must keep of their clause, which of them stand.

An answer is a variant, so no form it may have can end a job. Its rules become rows, their duties
and remedies rows beside them. Conditions become alternatives (arrays of comparisons that hold
together), and what a clause demands is checked on every alternative. A fault refuses the group of
its rule as a whole; a fault of form refuses the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions import text as tx
from policyspark.functions import truth as tr
from policyspark.operators.policy import DEMONSTRATIVE, OPERATORS

KINDS = ("permission", "prohibition", "obligation", "restriction")
MOST_CONDITIONS, DEEPEST, CHILDREN = 16, 2, (2, 8)
GROUPS = ("all", "any", "exactly_one")
LEAF = "struct<field:string,op:string,value:string,parameter:string,unit:string>"
# Verbs that need no like word in the clause, words of a limit, of an exception, of a qualifier behind an asset, of vague parties and assets.
CANONICAL = ("read", "delete", "notify", "inform", "report", "provideaccess", "keepconfidential", "obtainapproval", "requestdelay", "distribute", "reproduce")
TELLS = ("notify", "inform", "report")
READS = ("read", "access", "retrieve", "use")
GRANTS = ("provideaccess", "grantaccess", "grant")
ONLY = r"\b(?:shall|must|may|can)\s+(?:only\s+(?:be\s+)?(?:used?|shared?|disclosed?)|be\s+(?:used|shared|disclosed)\s+only|not\s+(?:use|share|disclose)\b[^.;]*\bother than)\b"
EXCEPTION = r"\b(?:unless|except|without|outside|other than|non[- ]|unauthori[sz]ed|unapproved|only|but)\b"
QUALIFIER = r"(?i)[ ,]*\b((?:necessary for|in accordance with|in connection with|in relation to|to the extent|that might|that could|discovered in|for all|for any)\b.*)$"
HEDGES = r"(?i)\b(?:not|no|unless|except|provided that|shall|must|may|will)\b"
NO_PARTY = ("data", "personal data", "project data", "use", "modify", "any", "*")
NO_ASSET = ("any", "*", "use", "modify", "all", "everything")
NO_FIELD = ("clause_id", "clauseid", "referenceclause", "business day")


# ---- JSON of any form


def node_type(depth: int) -> str:
    """A condition: a comparison, or a group of conditions one level less deep."""
    below = node_type(depth - 1) if depth else "variant"
    return "struct<field:string,op:string,value:variant,parameter:string,unit:string," + ",".join(f"{g}:array<{below}>" for g in GROUPS) + ">"


NODES = f"array<{node_type(DEEPEST)}>"
DUTY = f"struct<actor:string,action:string,asset:string,evidence:string,issuer:string,role:string,conditions:{NODES}>"
PLANNED = f"struct<kind:string,actor:string,action:string,asset:variant,evidence:string,source:string,`group`:string,role:string,issuer:string,conditions:{NODES},allowed_when:{NODES},duties:array<{DUTY}>,remedies:array<{DUTY}>>"
PLAN = f"struct<rules:array<{PLANNED}>,parameters:array<struct<key:string,label:string,type:string>>,unrepresented:array<variant>,reason:string>"


def kind_of(v: Column, name: str) -> Column:
    """The type of a member of a variant: STRING, BIGINT, ARRAY<..>, OBJECT<..>; null where there is none or it is null."""
    return F.nullif(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))


def held(values: Column, of: str) -> Column:
    """A list, or an empty one."""
    return F.coalesce(values, F.array().cast(of))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def quoted(text: Column) -> Column:
    """A text as a JSON text."""
    return bound(F.to_json(F.array(text)), lambda whole: F.substring(whole, F.lit(2), F.length(whole) - 2))


# ---- conditions


def leaf_of(c: Column) -> Column:
    return F.struct(c["field"].alias("field"), c["op"].alias("op"), F.to_json(c["value"]).alias("value"), c["parameter"].alias("parameter"), c["unit"].alias("unit"))


def made_leaf(field: str | Column, op: str | Column, value: Column) -> Column:
    """A comparison with a JSON text on its right side."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return F.struct(lit(field).alias("field"), lit(op).alias("op"), value.alias("value"), none.alias("parameter"), none.alias("unit"))


def parts_of(c: Column) -> Column:
    """What a group joins; null: c is a comparison."""
    return F.coalesce(*[c[g] for g in GROUPS])


def node_faults(c: Column, depth: int = DEEPEST) -> Column:
    """What is wrong with the form of a condition: groups that stand alone, two deep at most, comparisons with one right side."""
    size = F.size(parts_of(c))
    several = sum((c[g].isNotNull().cast("int") for g in GROUPS), F.lit(0)) > 1
    beside = F.concat_ws("", c["field"], c["op"], c["parameter"]) != ""
    alone = F.when(several | beside | (size < CHILDREN[0]) | (size > CHILDREN[1]), "a group has 2 to 8 conditions and stands alone")
    right = (c["value"].isNotNull().cast("int") + c["parameter"].isNotNull().cast("int")) == 1
    leaf = F.when(~F.coalesce(c["field"].isNotNull() & c["op"].isin(*OPERATORS) & right, F.lit(False)), "a comparison has a field, a known operator and one right side")
    below = F.array(F.lit("groups nest too deep")) if depth == 0 else F.flatten(F.transform(parts_of(c), lambda x: node_faults(x, depth - 1)))
    return F.when(parts_of(c).isNull(), F.array(leaf)).otherwise(F.concat(F.array(alone), below))


def alternatives(c: Column, depth: int = DEEPEST) -> Column:
    """The alternatives of a condition, each an array of comparisons: products over `all`, one after the other over other groups."""
    one = F.array(F.array(leaf_of(c)))
    if depth == 0:
        return one
    each = F.transform(parts_of(c), lambda x: alternatives(x, depth - 1))
    return F.when(parts_of(c).isNull(), one).otherwise(bound(each, lambda e: F.when(c["all"].isNotNull(), crossed(e)).otherwise(F.flatten(e))))


def crossed(each: Column) -> Column:
    """Every choice of one alternative from each of several lists, put together."""
    none = F.array(F.array().cast(f"array<{LEAF}>"))
    return F.aggregate(each, none, lambda done, more: F.flatten(F.transform(done, lambda a: F.transform(more, lambda b: F.concat(a, b)))))


def leaves_of(c: Column, depth: int = DEEPEST) -> Column:
    """All comparisons of a condition in order."""
    one = F.array(leaf_of(c))
    return one if depth == 0 else F.when(parts_of(c).isNull(), one).otherwise(F.flatten(F.transform(parts_of(c), lambda x: leaves_of(x, depth - 1))))


def leaf_json(x: Column) -> Column:
    """A comparison as JSON."""
    right = F.when(x["parameter"].isNotNull(), F.concat(F.lit(',"parameter":'), quoted(x["parameter"]))).otherwise(F.concat(F.lit(',"value":'), F.coalesce(x["value"], F.lit("null"))))
    return F.concat(F.lit('{"field":'), quoted(x["field"]), F.lit(',"op":'), quoted(x["op"]), right, F.when(x["unit"].isNotNull(), F.concat(F.lit(',"unit":'), quoted(x["unit"]))).otherwise(""), F.lit("}"))


def node_json(c: Column, read: Callable[[Column], Column], depth: int = DEEPEST) -> Column:
    """A condition as JSON, its comparisons as they are read."""
    whole = F.transform(F.flatten(F.transform(F.array(leaf_of(c)), read)), leaf_json)
    leaf = bound(whole, lambda w: F.when(F.size(w) == 1, w[0]).otherwise(F.concat(F.lit('{"all":['), F.array_join(w, ","), F.lit("]}"))))
    if depth == 0:
        return leaf
    name = F.when(c["all"].isNotNull(), "all").when(c["any"].isNotNull(), "any").otherwise("exactly_one")
    return F.when(parts_of(c).isNull(), leaf).otherwise(F.concat(F.lit('{"'), name, F.lit('":['), F.array_join(F.transform(parts_of(c), lambda x: node_json(x, read, depth - 1)), ","), F.lit("]}")))


def turned_op(op: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in tr.REVERSED.items() for x in kv]), op)


def turned(c: Column, depth: int = DEEPEST) -> Column:
    """The complement of a condition as JSON: groups change places, comparisons turn round. Null where there is none."""
    leaf = bound(leaf_of(c), lambda x: F.when(turned_op(x["op"]).isNotNull(), leaf_json(x.withField("op", turned_op(x["op"])))))
    if depth == 0:
        return leaf
    opened = F.when(c["all"].isNotNull(), '{"any":[').otherwise('{"all":[')
    inner = F.transform(parts_of(c), lambda y: turned(y, depth - 1))
    whole = bound(inner, lambda i: F.when(~F.exists(i, lambda y: y.isNull()), F.concat(opened, F.array_join(i, ","), F.lit("]}"))))
    return F.when(parts_of(c).isNull(), leaf).when(c["exactly_one"].isNull(), whole)


def reader(text: Column) -> Callable[[Column], Column]:
    """How the comparisons of a clause are read: PTnD where it says n days, no unit beside an ISO duration, a worded deadline as its clock and event."""

    def read(x: Column) -> Column:
        value = tr.bare(x["value"])
        days = F.regexp_extract(value, r"^PT(\d+)D$", 1)
        clock = x["field"].isin("elapsedTime", "postponementDuration")
        fixed = F.when(clock & (days != "") & F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), days, F.lit(r"\s+(?:calendar\s+)?days?\b"))), F.concat(F.lit('"P'), days, F.lit('D"'))).otherwise(x["value"])
        iso = clock & value.rlike(r"^P(?:T?\d+D|T\d+H)$")
        plain = F.struct(x["field"].alias("field"), x["op"].alias("op"), fixed.alias("value"), x["parameter"].alias("parameter"), F.when(~F.coalesce(iso, F.lit(False)), x["unit"]).alias("unit"))
        within, once = r"(?i)^within\s+(\d+)\s+(hour|day)s?\s+(?:after|of|from)\s+(.+?)\.?$", r"(?i)^once\s+(\d+)\s+(hour|day)s?\s+have elapsed since\s+(.+?)\.?$"
        worded = (F.lower(x["field"]) == "timing") & (x["op"] == "eq") & (value.rlike(within) | value.rlike(once)) & F.contains(tx.folded(text), tx.folded(value)) & ~F.lower(text).rlike(r"\bbusiness day")
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(value, within, i), F.lit("")), F.regexp_extract(value, once, i))
        length = F.when(F.lower(part(2)) == "hour", F.concat(F.lit('"PT'), part(1), F.lit('H"'))).otherwise(F.concat(F.lit('"P'), part(1), F.lit('D"')))
        event = F.regexp_replace(F.regexp_replace(part(3), r"(?i)^the\s+", ""), r"(?i)\s+(?:is|was) issued$", "")
        both = F.array(made_leaf("elapsedTime", F.when(value.rlike(within), "lteq").otherwise("gteq"), length), made_leaf("event", "eq", quoted(event)))
        return F.when(F.coalesce(worded, F.lit(False)), both).otherwise(F.array(plain))

    return read


# ---- plans to rows


def planned(answers: DataFrame) -> DataFrame:
    """A row a rule, duty or remedy of each answer, and a row without one where an answer has none.

    answers: contract_id, ord, text, texts (of its evidence), ids (of its evidence), cap, kind (the only
    one, or null), answer_json. Added: plan, form (faults of the answer's form), n (place in the plan),
    spot (place among its assets), seat (0: the rule itself), role, rule, v (the part), asset.
    """
    v, p = F.col("raw"), F.col("plan")
    lists = lambda of, *names: F.exists(F.array(*[~kind_of(of, n).startswith("ARRAY") for n in names]), lambda x: x)
    objects = lambda of, *names: F.exists(F.concat(*[F.coalesce(F.try_variant_get(of, f"$.{n}", "array<variant>"), F.array().cast("array<variant>")) for n in names]), lambda x: ~F.schema_of_variant(x).startswith("OBJECT"))
    parameters, rules = held(p["parameters"], "array<struct<key:string,label:string,type:string>>"), held(p["rules"], f"array<{PLANNED}>")
    shape = F.array(
        F.when(v.isNull(), "answer is not JSON"),
        F.when(v.isNotNull() & ~F.coalesce(kind_of(v, "rules").startswith("ARRAY"), F.lit(False)), "plan has no rules"),
        F.when(F.size(rules) > F.col("cap"), F.concat(F.lit("plan has over "), F.col("cap").cast("string"), F.lit(" rules"))),
        F.when(lists(v, "unrepresented", "parameters"), "what is unrepresented and parameters are lists"),
        F.when(objects(v, "rules", "parameters"), "rules and parameters are objects"),
        F.when(F.exists(parameters, lambda q: q["key"].isNull() | q["label"].isNull() | q["type"].isNull()), "a parameter has a key, a label and a type"),
        F.when(F.size(F.array_distinct(F.transform(parameters, lambda q: q["key"]))) < F.size(parameters), "parameter keys are unique"),
        F.when(F.exists(F.try_variant_get(v, "$.rules", "array<variant>"), lambda r: lists(r, "conditions", "allowed_when", "duties", "remedies") | objects(r, "conditions", "allowed_when", "duties", "remedies") | F.exists(F.array(*[kind_of(r, n) != "STRING" for n in ("kind", "actor", "action", "evidence", "source")]), lambda x: x)), "a rule's fields are texts, its conditions, duties and remedies lists"),
    )
    rows = answers.withColumns({"raw": F.try_parse_json("answer_json"), "plan": F.from_json("answer_json", PLAN)})
    of_rules = F.flatten(F.transform(rules, lambda r: rule_form(r, F.col("ids"), F.col("kind"))))
    rows = rows.withColumn("form", F.array_distinct(F.filter(F.concat(shape, F.coalesce(of_rules, F.array().cast("array<string>"))), lambda x: x.isNotNull()))).drop("raw")
    rows = rows.select("*", F.posexplode_outer(F.when(F.size("form") == 0, p["rules"])).alias("n", "rule"))
    r = F.col("rule")
    assets = F.coalesce(F.try_variant_get(r["asset"], "$", "array<string>"), F.array(F.try_variant_get(r["asset"], "$", "string")))
    rows = rows.select("*", F.posexplode_outer(F.when(r.isNotNull(), assets)).alias("spot", "own_asset"))
    own = F.struct(r["actor"].alias("actor"), r["action"].alias("action"), F.col("own_asset").alias("asset"), r["evidence"].alias("evidence"), r["issuer"].alias("issuer"), r["role"].alias("role"), r["conditions"].alias("conditions")).cast(DUTY)
    seated = lambda parts, role, first: F.transform(held(parts, f"array<{DUTY}>"), lambda d, i: F.struct((i + first).alias("seat"), F.lit(role).alias("role"), d.alias("v")))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("seat"), F.lit("rule").alias("role"), own.alias("v"))), seated(r["duties"], "duty", 1), seated(r["remedies"], "remedy", 101))
    rows = rows.select("*", F.explode_outer(F.when(r.isNotNull(), parts)).alias("p"))
    return rows.select("*", "p.seat", "p.role", "p.v", "p.v.asset").drop("p", "own_asset")


def rule_form(r: Column, ids: Column, only: Column) -> Column:
    """Faults of the form of a planned rule."""
    filled = lambda v, *names: F.forall(F.array(*[F.coalesce(F.length(F.trim(v[n])) > 0, F.lit(False)) for n in names]), lambda x: x)
    one, several = F.schema_of_variant(r["asset"]) == "STRING", F.schema_of_variant(r["asset"]) == "ARRAY<STRING>"
    nodes = lambda conditions: F.flatten(F.transform(held(conditions, NODES), lambda c: node_faults(c)))
    count = F.aggregate(F.concat(held(r["conditions"], NODES), held(r["allowed_when"], NODES)), F.lit(0), lambda n, c: n + F.size(leaves_of(c)))
    beside = F.concat(held(r["duties"], f"array<{DUTY}>"), held(r["remedies"], f"array<{DUTY}>"))
    own = F.array(
        F.when(~(filled(r, "kind", "actor", "action", "evidence") & F.coalesce(one | several, F.lit(False))), "a rule lacks a field"),
        F.when(~F.coalesce(r["kind"].isin(*KINDS), F.lit(False)) | F.coalesce(r["kind"] != only, F.lit(False)), "a rule of such a kind can't come from this clause"),
        F.when(r["source"].isNotNull() & ~F.coalesce(F.array_contains(ids, r["source"]), F.lit(False)), "a rule names a source that was not given"),
        F.when(count > MOST_CONDITIONS, f"a rule has over {MOST_CONDITIONS} conditions"),
        F.when(F.exists(beside, lambda d: ~filled(d, "actor", "action", "asset")), "a duty lacks a field"),
    )
    return F.concat(own, nodes(r["conditions"]), nodes(r["allowed_when"]), F.flatten(F.transform(beside, lambda d: nodes(d["conditions"]))))


def prepared(rows: DataFrame) -> DataFrame:
    """Rows of `planned` with what checks look at: final_kind, actor, action, label (the asset without its qualifier), conditions (JSON), leaves, branches, t (the clause folded), cited (with its evidence)."""
    v, rule = F.col("v"), F.col("rule")
    allowed = F.when(F.col("role") == "rule", held(rule["allowed_when"], NODES)).otherwise(F.array().cast(NODES))
    final = F.when(F.col("role") == "rule", F.when(rule["kind"] == "restriction", "prohibition").otherwise(rule["kind"])).otherwise(F.col("role"))
    rows = rows.withColumns({
        "planned_kind": rule["kind"], "final_kind": final, "actor": v["actor"], "party": v["role"], "issuer": v["issuer"], "action": v["action"], "act": F.lower(v["action"]), "evidence": F.coalesce(v["evidence"], rule["evidence"]),
        "group": F.coalesce(rule["group"], F.col("n").cast("string")), "t": tx.folded(F.col("text")), "source_text": F.concat_ws(" \n ", F.col("text"), F.array_join(F.coalesce("texts", F.array().cast("array<string>")), " \n ")),
        "qualifier": F.nullif(F.regexp_extract("asset", QUALIFIER, 1), F.lit("")), "turned": F.transform(allowed, lambda c: turned(c)),
    })
    opposite = F.from_json(F.concat(F.lit("["), F.array_join(F.filter("turned", lambda x: x.isNotNull()), ","), F.lit("]")), NODES)
    rows = rows.withColumns({
        "cited": tx.folded(F.col("source_text")), "label": F.when(F.col("qualifier").isNotNull(), F.regexp_replace("asset", QUALIFIER, "")).otherwise(F.col("asset")), "nodes": F.concat(held(v["conditions"], NODES), held(opposite, NODES)),
        "limit": F.when(F.col("qualifier").isNotNull(), F.array(made_leaf(F.when(F.lower("qualifier").startswith("in accordance"), "compliance").otherwise("scope"), "eq", quoted(F.col("qualifier"))))).otherwise(F.array().cast(f"array<{LEAF}>")),
    })
    read = reader(F.col("text"))
    again = lambda leaves: F.flatten(F.transform(leaves, read))
    return rows.withColumns({
        "conditions": F.concat(F.transform("nodes", lambda c: node_json(c, read)), F.transform("limit", leaf_json)),
        "leaves": F.concat(again(F.flatten(F.transform("nodes", lambda c: leaves_of(c)))), F.col("limit")),
        "branches": F.transform(crossed(F.concat(F.transform("nodes", lambda c: alternatives(c)), F.transform("limit", lambda x: F.array(F.array(x))))), again),
    })


# ---- checks


def every(test: Callable[[Column], Column]) -> Column:
    """Whether each alternative has a comparison that passes."""
    return F.forall("branches", lambda b: F.exists(b, lambda x: F.coalesce(test(x), F.lit(False))))


def some(test: Callable[[Column], Column]) -> Column:
    return F.exists("leaves", lambda x: F.coalesce(test(x), F.lit(False)))


def word_in(words: Column, text: Column) -> Column:
    """Whether words stand in a text as whole words."""
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}_'-]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.trim(F.regexp_replace(words, r"[^\p{L}\p{N}_'-]+", " ")), F.lit(" ")))


def checks() -> list[tuple[str, Column]]:
    """(fault, whether it is there) of rows of `prepared`: what a clause demands and a rule leaves out, turns round or adds."""
    t, cited, act, kind = F.col("t"), F.col("cited"), F.col("act"), F.col("final_kind")
    low = lambda x: tx.folded(tr.bare(x["value"]))
    is_ = lambda x, *names: F.lower(x["field"]).isin(*names)
    found = lambda pattern, i=1, of=t: F.nullif(F.regexp_extract(of, pattern, i), F.lit(""))
    actor, asset = tx.folded(F.col("actor")), tx.folded(F.col("label"))
    tells, reads, grants = act.isin(*TELLS), act.isin(*READS), act.isin(*GRANTS)
    modal = t.rlike(r"\b(?:shall|must|may|can|will)\b")
    verb = F.regexp_replace(F.lower(F.regexp_extract("action", r"^([A-Z]?[a-z]+)", 1)), r"e$", "")
    tokens = F.regexp_extract_all(asset, F.lit(r"([\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*)"), F.lit(1))
    own = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*)"), F.lit(1))
    composed = (F.size(tokens) > 0) & F.forall(tokens, lambda w: F.array_contains(own, w) | F.array_contains(own, F.concat(w, F.lit("s"))))
    legal = found(r"\bunless (disclosure|retention) is required by law\b")
    seconds = lambda x: tx.duration_seconds(F.upper(tr.bare(x["value"])))
    number, unit = found(r"\bwithin (\d+)\s*(?:\([^)]*\)\s*)?(?:hour|day)s?\b").cast("int"), found(r"\bwithin \d+\s*(?:\([^)]*\)\s*)?(hour|day)s?\b")
    limit = number * F.when(unit == "hour", 3600).otherwise(86400)
    waited = found(r"\bonce (\d+) (?:days?|hours?) have elapsed\b")
    recipient = found(r"(?i)\b(?:notify|inform)\s+(?:(?:the|all|each)\s+)?([A-Z][\w-]*(?:\s+[A-Z][\w-]*){0,3})\s+(?:of|about|without|within|regarding|that)\b", of=F.col("text"))
    recipient = F.when(recipient.rlike(r"^\p{Lu}"), tx.folded(recipient))
    sender = found(r"\b(?:The\s+)?([A-Z][\w-]*(?:\s+[A-Z][\w-]*){0,3})\s+(?:must|shall)\s+(?:notify|inform)\b", of=F.col("text"))
    period, shared = found(r"\b(for the duration of [^,.;]{1,90}),"), found(r"\b(during [^,.;]{1,90},? and for (?:a )?subsequent period of [^,.;]{1,70}),")
    timing = lambda words: every(lambda x: is_(x, "timing") & (x["op"] == "eq") & (low(x) == words))
    plain = lambda x: F.regexp_replace(low(x), r"^the ", "")
    granted = found(r"\bmay\s+grant\s+(?:(?:the|a|an)\s+)?(.{1,120}?)(?:,\s+(?:in|at)\s+[^,]{1,100},)?\s+(?:(?:direct|electronic)\s+)*access\b")
    secured = t.rlike(r"\baccess\b.{0,100}\b(?:depends on|subject to|only if|conditional on)\b.{0,240}\bsecurity requirements\b")
    free = t.rlike(r"\b(?:at no charge|no charge|free of charge|royalty[- ]free)\b")
    duties = F.lower(F.to_json(held(F.col("rule.duties"), f"array<{DUTY}>")))
    said = lambda word: F.forall("branches", lambda b: F.contains(F.lower(F.to_json(b)), F.lit(word)) | F.contains(duties, F.lit(word)) | F.contains(asset, F.lit(word)))
    exceptions = lambda: F.exists(F.filter("nodes", lambda c: parts_of(c).isNull()), lambda c: (F.lower(c["field"]) == "exception") & c["op"].isin("eq", "isAnyOf", "isA"))

    def joined(x: Column) -> Column:
        """Whether the clause joins the members of a list by `and`, never by `or`."""
        inner = F.transform(F.from_json(x["value"], "array<string>"), lambda m: F.struct(F.instr(t, tx.folded(m)).alias("at"), F.length(tx.folded(m)).alias("long")))
        first, last = F.array_min(F.transform(inner, lambda m: m["at"])), F.array_max(F.transform(inner, lambda m: m["at"] + m["long"]))
        span = F.substr(t, first, last - first)
        return (F.size(inner) > 1) & (first > 0) & span.rlike(r"\band\b") & ~span.rlike(r"\bor\b")

    parameters, rules = held(F.col("plan.parameters"), "array<struct<key:string,label:string,type:string>>"), held(F.col("plan.rules"), f"array<{PLANNED}>")
    keys = F.transform(parameters, lambda p: p["key"])
    typed = lambda x: F.exists(parameters, lambda p: (p["key"] == x["parameter"]) & (p["type"] == "duration"))
    same = lambda o: F.struct(*[o[k].alias(k) for k in ("kind", "actor", "action", "conditions", "issuer", "duties", "remedies")])
    alike = lambda o: F.to_json(same(o)) == F.to_json(same(F.col("rule")))
    named = lambda o: F.try_variant_get(o["asset"], "$", "string")
    general = F.exists(rules, lambda o: (named(o) != F.col("asset")) & alike(o) & F.regexp_like(t, F.concat(F.lit(r"(?<!\w)\Q"), tx.folded(named(o)), F.lit(r"\E\s*,?\s*(?:such as|for example|including)\s+(?:(?:an?|the)\s+)?\Q"), asset, F.lit(r"\E(?!\w)"))))
    address = lambda s: F.exists(F.regexp_extract_all(s, F.lit(r"""((?:https?://|urn:|did:)[^\s"'\\]+)"""), F.lit(1)), lambda u: ~F.contains(F.col("source_text"), u))
    dated = lambda s: F.exists(F.regexp_extract_all(s, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), lambda d: ~F.contains(F.col("source_text"), d))
    literal = F.coalesce(F.col("party"), F.lit("literal")) == "literal"
    main = F.col("role") == "rule"
    return [
        # what a rule takes from its clause
        ("evidence isn't in the clause", ~F.contains(t, tx.folded(F.col("evidence")))),
        ("asset points elsewhere", asset.rlike(DEMONSTRATIVE) | asset.rlike(r"^(?:all|any|the)\s+(?:such|this|these|that|those)\b")),
        ("actor isn't in the clause", literal & ~word_in(actor, cited)),
        ("asset isn't in the clause", ~word_in(asset, cited) & ~composed),
        ("an asset joins listed ones", ~word_in(asset, cited) & composed & t.rlike(r"\([ivx]+\)") & asset.rlike(r"[,;]")),
        ("issuer isn't in the clause", F.col("issuer").isNotNull() & ~word_in(tx.folded(F.col("issuer")), cited)),
        ("party and asset are one", actor == asset),
        ("a party is an asset or an action", actor.isin(*NO_PARTY)),
        ("asset is everything", asset.isin(*NO_ASSET)),
        ("a qualifier of the asset is ambiguous", F.col("qualifier").isNotNull() & ((asset == "") | F.col("asset").rlike(HEDGES))),
        ("a role isn't in the clause", ~literal & ~((F.col("party") == F.col("actor")) & (((F.col("party") == "requester") & t.rlike(r"\brequests?\b")) | ((F.col("party") == "access_provider") & t.rlike(r"\baccess\b") & t.rlike(r"\b(?:shall|must)\s+be\s+granted\b"))))),
        ("action is not one verb", F.col("action").rlike(r"(?i)\b(?:and|or)\b|[,;\s]") | F.col("action").rlike("[a-z](?:And|Or)[A-Z]")),
        ("action isn't in the clause", modal & (verb != "") & ~act.isin(*CANONICAL) & ~F.regexp_like(t, F.concat(F.lit(r"\b"), verb, F.lit(r"[a-z]*\b")))),
        ("a delivery is no grant of access", (act == "provideaccess") & t.rlike(r"\b(?:shar(?:e|es|ing|ed)|produce|submit|supply|deliver)\b") & ~t.rlike(r"\b(?:access|available|grant(?:ed|ing|s)?)\b")),
        ("nothing in the clause is told", act.isin("notify", "inform") & t.rlike(r"\b(?:shall|must|may|can)\b") & ~t.rlike(r"\b(?:notif|inform|report|aware|tell|told|show)")),
        ("nothing in the clause is approved", (act == "obtainapproval") & t.rlike(r"\b(?:shall|must|may|can)\b") & ~t.rlike(r"\b(?:approv|consent|authori[sz])")),
        ("invented address", some(lambda x: address(x["value"])) | address(F.concat_ws(" ", "actor", "action", "asset"))),
        ("invented date", some(lambda x: dated(x["value"])) | dated(F.col("asset"))),
        ("a citation is no condition", some(lambda x: is_(x, *NO_FIELD))),
        ("an example repeats its general rule", main & general),
        # kinds
        ("a restriction needs an `only`", (F.col("planned_kind") == "restriction") & main & ~t.rlike(ONLY)),
        ("a restriction needs what is allowed", (F.col("planned_kind") == "restriction") & main & (F.size("turned") == 0)),
        ("no complement", F.exists("turned", lambda x: x.isNull())),
        ("only a restriction has what is allowed", (F.col("planned_kind") != "restriction") & main & (F.size("turned") > 0)),
        ("duties belong to permissions, remedies to prohibitions", main & (((kind != "permission") & (F.size("rule.duties") > 0)) | ((kind != "prohibition") & (F.size("rule.remedies") > 0)))),
        ("an exception isn't in the clause", main & (F.col("planned_kind") == "prohibition") & ~t.rlike(EXCEPTION) & some(lambda x: is_(x, "purpose", "recipient") & x["op"].isin("neq", "isNoneOf"))),
        ("a condition of access is no duty", main & (kind == "obligation") & F.contains(asset, F.lit("security requirements")) & t.rlike(r"\baccess\b.{0,100}\b(?:depends on|subject to|only if|conditional on)\b") & ~t.rlike(r"\b(?:shall|must)\s+(?:meet|comply|satisfy|maintain)\b")),
        # what every alternative has to keep
        ("a legal exception is missing", legal.isNotNull() & (((kind == "prohibition") & act.isin("share", "disclose") & (legal == "disclosure")) | ((kind == "obligation") & (act == "delete") & (legal == "retention"))) & ~every(lambda x: is_(x, "compliance") & (x["op"] == "neq") & (low(x) == F.concat(legal, F.lit(" required by law"))))),
        ("a period is missing", (period.isNotNull() & (kind == "permission") & ~timing(period)) | (shared.isNotNull() & act.isin("keepconfidential", "store") & ~timing(shared))),
        ("completeness is missing", (act == "maintain") & t.rlike(r"\bmaintain complete\b") & ~said("complete")),
        ("a grant lacks its recipient", (kind == "permission") & grants & granted.isNotNull() & ~every(lambda x: is_(x, "recipient") & (plain(x) == granted))),
        ("a grant lacks its discretion", (kind == "permission") & grants & t.rlike(r"\bsole discretion\b") & ~every(lambda x: is_(x, "discretion") & F.contains(low(x), F.lit("discretion")))),
        ("a grant lacks its scope", (kind == "permission") & grants & t.rlike(r"\bdirect electronic access\b") & ~every(lambda x: is_(x, "scope") & (x["op"] == "eq") & (low(x) == "direct electronic access"))),
        ("a grant lacks its security", (kind == "permission") & (grants | reads) & secured & ~said("security")),
        ("the price is missing", (kind == "permission") & reads & free & ~every(lambda x: is_(x, "payamount", "price", "fee", "payment") & (x["op"] == "eq") & (tr.number(x["value"]) == 0)) & ~(said("no charge") | said("free of charge") | said("royalty"))),
        ("the work plan is missing", (kind == "permission") & reads & t.rlike(r"\bin accordance with the work plan\b") & ~F.forall("branches", lambda b: F.contains(F.lower(F.to_json(b)), F.lit("work plan")) | (t.rlike(r"\bwork plan or with .+? prior written consent\b") & F.exists(b, lambda x: is_(x, "approval") & (x["op"] == "eq"))))),
        ("necessity is missing", (kind == "permission") & reads & F.regexp_like(t, F.concat(F.lit(r"(?<!\w)\Q"), asset, F.lit(r"\E\s+(?:that (?:is|are) )?necessary\b"))) & ~said("necessary")),
        ("a recipient is missing", tells & recipient.isNotNull() & ~every(lambda x: is_(x, "recipient"))),
        ("another recipient is told", tells & recipient.isNotNull() & some(lambda x: is_(x, "recipient") & (x["op"] == "eq") & (plain(x) != recipient))),
        ("another party tells", tells & sender.isNotNull() & (F.regexp_replace(actor, r"^the ", "") != tx.folded(sender))),
        ("undue delay is missing", tells & t.rlike(r"\bwithout undue delay\b") & ~timing(F.lit("without undue delay"))),
        ("the event is another", tells & t.rlike(r"\b(?:of|after) (?:becoming aware|discovery|discovering|awareness)\b") & some(lambda x: is_(x, "event", "trigger") & ~low(x).rlike(r"\b(?:aware|discover)"))),
        ("a time limit is missing", (main | tells) & limit.isNotNull() & ~t.rlike(r"\bbusiness days\b") & F.when(tells, ~every(lambda x: is_(x, "elapsedtime") & (x["parameter"].isNotNull() | (x["op"].isin("lt", "lteq") & (seconds(x) <= limit))))).otherwise(~some(lambda x: is_(x, "elapsedtime") & (x["parameter"].isNotNull() | (seconds(x) == limit))))),
        ("a time limit runs the wrong way", (limit.isNotNull() & some(lambda x: is_(x, "elapsedtime") & x["op"].isin("gt", "gteq") & (seconds(x) == limit))) | (waited.isNotNull() & some(lambda x: is_(x, "elapsedtime") & x["op"].isin("lt", "lteq") & (F.regexp_extract(tr.bare(x["value"]), r"(\d+)", 1) == waited)))),
        ("a waiting time is missing", main & waited.isNotNull() & ~some(lambda x: is_(x, "elapsedtime") & (x["parameter"].isNotNull() | (F.regexp_extract(tr.bare(x["value"]), r"(\d+)", 1) == waited)))),
        ("a time limit lacks its event", main & (limit.isNotNull() | waited.isNotNull()) & some(lambda x: is_(x, "elapsedtime")) & ~some(lambda x: is_(x, "event", "trigger"))),
        ("a shorter period is missing", tells & t.rlike(r"\bunless\b[^.]*\bshorter\b") & ~F.lower(F.array_join("conditions", " ")).rlike(r"\b(?:shorter|earlier)\b")),
        ("a shorter period is no exception", tells & t.rlike(r"\bunless\b[^.]*\bshorter\b") & exceptions()),
        ("an alternative authorisation is no condition", kind.isin("permission", "obligation") & t.rlike(r"\bor as (?:agreed|authori[sz]ed|permitted)\b") & (F.size("nodes") > 1) & exceptions()),
        ("a list joined by `and` is no choice", some(lambda x: is_(x, "format", "quality", "recipient") & (x["op"] == "isAnyOf") & joined(x))),
        ("compliance is no purpose", (kind == "permission") & some(lambda x: is_(x, "purpose") & (x["op"] == "isAnyOf") & bound(F.from_json(x["value"], "array<string>"), lambda ms: (F.size(ms) > 1) & F.exists(ms, lambda m: F.lower(m).rlike(r"\b(?:in accordance with|subject to|comply|compliance)\b"))))),
        # right sides
        ("duration isn't ISO", some(lambda x: is_(x, "elapsedtime", "postponementduration") & x["parameter"].isNull() & x["op"].isin("lt", "lteq", "gt", "gteq") & tx.duration_seconds(F.upper(tr.bare(x["value"]))).isNull())),
        ("a parameter isn't declared", some(lambda x: x["parameter"].isNotNull() & ~F.array_contains(keys, x["parameter"]))),
        ("a time limit's parameter is no duration", some(lambda x: is_(x, "elapsedtime") & x["parameter"].isNotNull() & ~typed(x))),
    ]


def checked(rows: DataFrame) -> DataFrame:
    """Rows of `prepared` with faults: the names of the checks they fail; none where there is no rule."""
    held = F.array(*[F.when(F.coalesce(there, F.lit(False)), name) for name, there in checks()])
    return rows.withColumn("faults", F.when(F.col("v").isNotNull(), F.filter(held, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))


RULE = "array<struct<n:int,spot:int,seat:int,role:string,group:string,kind:string,actor:string,party:string,issuer:string,action:string,asset:string,evidence:string,conditions:array<string>,unresolved:boolean>>"


def compiled(answers: DataFrame) -> DataFrame:
    """A row an answer: form (faults of its form), rules (RULE, those whose groups stand, duties and remedies behind their rule), refused (groups that don't), why (faults of content), unrepresented, reason.

    A row without an answer, or with one that is no JSON, has a fault of form.
    """
    rows = checked(prepared(planned(answers)))
    unresolved = F.exists("leaves", lambda x: x["parameter"].isNotNull()) | (F.coalesce(F.col("party"), F.lit("literal")) != "literal")
    one = F.struct("n", "spot", "seat", "role", "group", F.col("final_kind").alias("kind"), "actor", "party", "issuer", "action", F.col("label").alias("asset"), "evidence", "conditions", unresolved.alias("unresolved"), "faults")
    each = rows.groupBy("contract_id", "ord").agg(
        F.first("form").alias("form"), F.first(F.greatest(F.size("plan.unrepresented"), F.lit(0))).alias("unrepresented"), F.first("plan.reason").alias("reason"),
        F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), one))).alias("all"),
    )
    bad = F.array_distinct(F.transform(F.filter("all", lambda r: F.size(r["faults"]) > 0), lambda r: r["group"]))
    each = each.withColumn("refused", bad).withColumn("why", F.array_distinct(F.flatten(F.transform("all", lambda r: r["faults"]))))
    stands = F.transform(F.filter("all", lambda r: ~F.array_contains(F.col("refused"), r["group"])), lambda r: r.dropFields("faults"))
    return each.select("contract_id", "ord", "form", stands.cast(RULE).alias("rules"), "refused", "why", "unrepresented", "reason")


def gold_answers(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """The catalogue's own rules as the plans that a model would give: a row a rule, in the form `planned` takes, with `rule_json`."""
    one = F.concat(F.lit('{"field":'), quoted(F.col("field")), F.lit(',"op":'), quoted(F.col("op")), F.lit(',"value":'), F.col("value"), F.lit("}"))
    held = conditions.groupBy("contract_id", "clause_id").agg(F.sort_array(F.collect_list(F.struct("n", one.alias("c")))).alias("cs"))
    rows = rules.join(held, ["contract_id", "clause_id"], "left")
    texts = F.array_join(F.transform("cs", lambda x: x["c"]), ",")
    whole = F.to_json(F.struct("kind", "actor", "action", "asset", F.col("text").alias("evidence")))
    rule = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(',"conditions":['), F.coalesce(texts, F.lit("")), F.lit("]}"))
    none = F.array().cast("array<string>")
    return rows.select("contract_id", F.col("ord").cast("int").alias("ord"), "clause_id", "o_orderkey", F.col("kind").alias("gold_kind"), F.col("actor").alias("gold_actor"), F.col("asset").alias("gold_asset"), "text", none.alias("texts"), F.array(F.col("ord").cast("string")).alias("ids"), F.lit(4).alias("cap"), F.lit(None).cast("string").alias("kind"), rule.alias("rule_json"))
