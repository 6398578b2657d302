"""Policies as exchange documents and back, and what may be wrong with one: rules with duties and remedies, parameters, parties, metadata.

A document is a JSON text per agreement, put together from tables by columns and taken apart into
them again. Conditions keep their nesting; names change (field to leftOperand, all to and, ...).
Tables: rules (contract_id, rule_id, n, kind, actor, action, asset, issuer, source, conditions,
requires, remedies: JSON lists), parameters (contract_id, key, label, type, source), parties
(contract_id, key, role, source), metadata (contract_id, key, value), sources (contract_id, source, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.operators.compiler import DEEPEST, bound, quoted

# What members of a condition are called on either side, and rules by kind.
OWN = {"field": "field", "op": "op", "value": "value", "parameter": "parameter", "unit": "unit", "all": "all", "any": "any", "exactly_one": "exactly_one"}
OUTER = {"field": "leftOperand", "op": "operator", "value": "rightOperand", "parameter": "rightOperandReference", "unit": "unit", "all": "and", "any": "or", "exactly_one": "xone"}
KINDS = ("permission", "prohibition", "obligation")
GROUPS = ("all", "any", "exactly_one")


def node_type(names: dict[str, str], depth: int = DEEPEST) -> str:
    """A condition under such names."""
    below = node_type(names, depth - 1) if depth else "variant"
    return f"struct<{names['field']}:string,{names['op']}:string,{names['value']}:variant,{names['parameter']}:string,{names['unit']}:string," + ",".join(f"`{names[g]}`:array<{below}>" for g in GROUPS) + ">"


def renamed(c: Column, a: dict[str, str], b: dict[str, str], depth: int = DEEPEST) -> Column:
    """A condition under the names of a as JSON under those of b."""
    member = lambda name, value: F.concat(F.lit(f',"{b[name]}":'), value)
    right = F.when(c[a["parameter"]].isNotNull(), member("parameter", quoted(c[a["parameter"]]))).otherwise(member("value", F.coalesce(F.to_json(c[a["value"]]), F.lit("null"))))
    unit = F.when(c[a["unit"]].isNotNull(), member("unit", quoted(c[a["unit"]]))).otherwise("")
    leaf = F.concat(F.lit(f'{{"{b["field"]}":'), quoted(c[a["field"]]), member("op", quoted(c[a["op"]])), right, unit, F.lit("}"))
    if depth == 0:
        return leaf
    parts = F.coalesce(*[c[a[g]] for g in GROUPS])
    name = F.when(c[a["all"]].isNotNull(), b["all"]).when(c[a["any"]].isNotNull(), b["any"]).otherwise(b["exactly_one"])
    return F.when(parts.isNull(), leaf).otherwise(F.concat(F.lit('{"'), name, F.lit('":['), F.array_join(F.transform(parts, lambda x: renamed(x, a, b, depth - 1)), ","), F.lit("]}")))


def _list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _conditions(text: Column, a: dict[str, str], b: dict[str, str]) -> Column:
    """A JSON list of conditions under other names."""
    return bound(F.from_json(text, f"array<{node_type(a)}>"), lambda nodes: _list(F.transform(F.coalesce(nodes, F.array().cast(f"array<{node_type(a)}>")), lambda c: renamed(c, a, b))))


def _members(**members: Column) -> Column:
    """A JSON object of members that aren't null; values are JSON texts."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in members.items()]), F.lit("}"))


def _side(name: str) -> str:
    """Duties and remedies as they lie in a rule."""
    inner, outer = f"array<{node_type(OWN)}>", f"array<{node_type(OUTER)}>"
    return {"own": f"array<struct<actor:string,action:string,asset:string,conditions:{inner}>>", "outer": f"array<struct<assignee:string,action:string,target:string,`constraint`:{outer}>>"}[name]


def _beside_out(text: Column) -> Column:
    """Duties or remedies as the document has them; none: null."""
    one = lambda d: _members(assignee=quoted(d["actor"]), action=quoted(d["action"]), target=quoted(d["asset"]), constraint=F.when(F.size(d["conditions"]) > 0, _list(F.transform(d["conditions"], lambda c: renamed(c, OWN, OUTER)))))
    return bound(F.from_json(text, _side("own")), lambda ds: F.when(F.size(ds) > 0, _list(F.transform(ds, one))))


def _beside_back(parts: Column) -> Column:
    one = lambda d: _members(actor=quoted(d["assignee"]), action=quoted(d["action"]), asset=quoted(d["target"]), conditions=_list(F.transform(F.coalesce(d["constraint"], F.array().cast(f"array<{node_type(OUTER)}>")), lambda c: renamed(c, OUTER, OWN))))
    return F.coalesce(_list(F.transform(parts, one)), F.lit("[]"))


def documents(rules: DataFrame, parameters: DataFrame, parties: DataFrame, metadata: DataFrame) -> DataFrame:
    """(contract_id, document): each agreement's policy. Lists keep the order of the rules' n and of keys; what an agreement lacks is left out."""
    held = bound(_conditions(F.col("conditions"), OWN, OUTER), lambda t: F.when(t != "[]", t))
    one = _members(
        uid=quoted(F.col("rule_id")), order=F.col("n").cast("string"), assignee=quoted(F.col("actor")), assigner=F.when(F.col("issuer").isNotNull(), quoted(F.col("issuer"))), action=quoted(F.col("action")), target=quoted(F.col("asset")),
        constraint=held, duty=_beside_out(F.col("requires")), remedy=_beside_out(F.col("remedies")),
    )
    trace = _members(ruleUid=quoted(F.col("rule_id")), ruleType=quoted(F.col("kind")), source=quoted(F.col("source")))
    rows = rules.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("n", "kind", one.alias("j"), trace.alias("t")))).alias("rs"))
    of = lambda k: bound(F.filter("rs", lambda r: r["kind"] == k), lambda rs: F.when(F.size(rs) > 0, _list(F.transform(rs, lambda r: r["j"]))))

    def grouped(df: DataFrame, name: str, one: Column) -> DataFrame:
        return df.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("key", one.alias("j")))).alias(name)).withColumn(name, _list(F.transform(name, lambda x: x["j"])))

    q = lambda c: quoted(F.col(c))
    rows = rows.join(grouped(parameters, "ps", _members(uid=q("key"), label=q("label"), dataType=q("type"), source=q("source"))), "contract_id", "left")
    rows = rows.join(grouped(parties, "qs", _members(uid=q("key"), role=q("role"), source=q("source"))), "contract_id", "left")
    meta = metadata.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("key", F.concat(q("key"), F.lit(":"), q("value")).alias("j")))).alias("ms"))
    rows = rows.join(meta.withColumn("ms", F.concat(F.lit("{"), F.array_join(F.transform("ms", lambda x: x["j"]), ","), F.lit("}"))), "contract_id", "left")
    policy = _members(**{k: of(k) for k in KINDS})
    return rows.select("contract_id", _members(contract_id=quoted(F.col("contract_id")), policy=policy, traceability=_list(F.transform("rs", lambda r: r["t"])), parameterBindings=F.col("ps"), partyBindings=F.col("qs"), metadata=F.col("ms")).alias("document"))


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    """The tables of documents(contract_id, document): rules in order, parameters, parties, metadata."""
    rule = f"array<struct<uid:string,`order`:int,assignee:string,assigner:string,action:string,target:string,`constraint`:array<{node_type(OUTER)}>,duty:{_side('outer')},remedy:{_side('outer')}>>"
    binding = "array<struct<uid:string,label:string,dataType:string,role:string,source:string>>"
    form = f"struct<policy:struct<{','.join(f'{k}:{rule}' for k in KINDS)}>,traceability:array<struct<ruleUid:string,ruleType:string,source:string>>,parameterBindings:{binding},partyBindings:{binding},metadata:map<string,string>>"
    rows = docs.withColumn("d", F.from_json("document", form))
    kinded = lambda k: F.transform(F.coalesce(F.col(f"d.policy.{k}"), F.array().cast(rule)), lambda r: F.struct(F.lit(k).alias("kind"), r.alias("r")))
    kinds = F.concat(*map(kinded, KINDS))
    source = F.map_from_entries(F.transform("d.traceability", lambda t: F.struct(t["ruleUid"], t["source"])))
    held = F.transform(F.coalesce("r.constraint", F.array().cast(f"array<{node_type(OUTER)}>")), lambda c: renamed(c, OUTER, OWN))
    each = rows.select("contract_id", source.alias("source"), F.explode(kinds).alias("x")).select("contract_id", "source", "x.*")
    rules = each.select("contract_id", F.col("r.uid").alias("rule_id"), F.col("r.order").alias("n"), "kind", F.col("r.assignee").alias("actor"), "r.action", F.col("r.target").alias("asset"), F.col("r.assigner").alias("issuer"), F.try_element_at("source", F.col("r.uid")).alias("source"), _list(held).alias("conditions"), _beside_back(F.col("r.duty")).alias("requires"), _beside_back(F.col("r.remedy")).alias("remedies"))
    bindings = lambda name: rows.select("contract_id", F.explode(f"d.{name}").alias("b"))
    return {
        "rules": rules,
        "parameters": bindings("parameterBindings").select("contract_id", F.col("b.uid").alias("key"), "b.label", F.col("b.dataType").alias("type"), "b.source"),
        "parties": bindings("partyBindings").select("contract_id", F.col("b.uid").alias("key"), "b.role", "b.source"),
        "metadata": rows.select("contract_id", F.explode("d.metadata").alias("key", "value")),
    }


def violations(rules: DataFrame, parameters: DataFrame, parties: DataFrame, sources: DataFrame) -> DataFrame:
    """(contract_id, subject, fault): what makes a policy invalid, each by a join that finds no partner or a count.

    Rules whose id repeats, whose source is unknown, whose parameter or party isn't declared, which
    have duties or remedies of the wrong kind or an obligation without a party; parameters, parties and
    sources that nothing uses.
    """
    keyed = lambda df, subject, fault: df.select("contract_id", F.col(subject).alias("subject"), F.lit(fault).alias("fault"))
    named = F.flatten(F.array(*[F.regexp_extract_all(F.col(c), F.lit(r'"parameter":"((?:[^"\\]|\\.)*)"'), F.lit(1)) for c in ("conditions", "requires", "remedies")]))
    used = rules.select("contract_id", "rule_id", F.explode(F.array_distinct(named)).alias("key"))
    beside = F.concat(*[F.coalesce(F.from_json(c, "array<struct<actor:string>>"), F.array().cast("array<struct<actor:string>>")) for c in ("requires", "remedies")])
    acting = rules.select("contract_id", "rule_id", F.explode(F.concat(F.array("actor"), F.transform(beside, lambda d: d["actor"]))).alias("key")).where(F.col("key").startswith("urn:"))
    cited = rules.select("contract_id", "source").unionByName(parameters.select("contract_id", "source")).unionByName(parties.select("contract_id", "source"))
    n = F.count("*").over(Window.partitionBy("contract_id", "rule_id"))
    twice = rules.withColumn("_n", n).where("_n > 1").select("contract_id", "rule_id").distinct()
    found = [
        keyed(twice, "rule_id", "rule id repeats"),
        keyed(rules.join(sources, ["contract_id", "source"], "left_anti"), "rule_id", "source is unknown"),
        keyed(used.join(parameters, ["contract_id", "key"], "left_anti"), "rule_id", "parameter isn't declared"),
        keyed(acting.join(parties, ["contract_id", "key"], "left_anti"), "rule_id", "party isn't declared"),
        keyed(rules.where((F.col("kind") != "permission") & (F.col("requires") != "[]")), "rule_id", "only permissions have duties"),
        keyed(rules.where((F.col("kind") != "prohibition") & (F.col("remedies") != "[]")), "rule_id", "only prohibitions have remedies"),
        keyed(rules.where((F.col("kind") == "obligation") & (F.trim(F.coalesce("actor", F.lit(""))) == "")), "rule_id", "an obligation has a party"),
        keyed(parameters.join(used, ["contract_id", "key"], "left_anti"), "key", "parameter is unused"),
        keyed(parties.join(acting, ["contract_id", "key"], "left_anti"), "key", "party is unused"),
        keyed(sources.join(cited, ["contract_id", "source"], "left_anti"), "source", "source is unused"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
