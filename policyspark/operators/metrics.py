"""Scores of predicted labels and rules against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.functions.grouped import map_groups

LABELS = ("RELEVANT", "NOT_RELEVANT", "NEEDS_CONTEXT")
LOW_SUPPORT = 30


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def outcome(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Every gold row with its prediction; a missing or unknown label is ERROR and stays in every denominator."""
    known = F.col("label").isin(*LABELS)
    return gold.join(predicted, keys, "left").withColumn("predicted", F.when(known, F.col("label")).otherwise("ERROR")).drop("label")


def confusion(rows: DataFrame) -> DataFrame:
    """n for every gold and predicted label, zero cells too."""
    cells = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("gold")).select("gold", F.explode(F.array(*map(F.lit, (*LABELS, "ERROR")))).alias("predicted"))
    return cells.join(rows.groupBy("gold", "predicted").agg(F.count("*").alias("n")), ["gold", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_class(rows: DataFrame, *groups: str) -> DataFrame:
    """Support, precision, recall and F1 of each label. ERROR is a miss and never a false alarm."""
    flags = F.explode(F.array(*[F.struct(F.lit(x).alias("class"), (F.col("gold") == x).cast("int").alias("g"), (F.col("predicted") == x).cast("int").alias("p")) for x in LABELS]))
    sums = rows.select(*groups, flags.alias("f")).groupBy(*groups, "f.class").agg(F.sum(F.col("f.g") * F.col("f.p")).alias("tp"), F.sum("f.g").alias("support"), F.sum("f.p").alias("called"))
    p, r = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("called"))
    bounds = dict(zip(("precision_low", "precision_high", "recall_low", "recall_high"), (*wilson(F.col("tp"), F.col("called")), *wilson(F.col("tp"), F.col("support"))), strict=True))
    return sums.select(*groups, F.col("class").alias("label"), "support", p.alias("precision"), r.alias("recall"), F.when(F.col("support") + F.col("called") > 0, f1).alias("f1"), *[F.when(F.col("called" if n.startswith("p") else "support") > 0, c).alias(n) for n, c in bounds.items()])


def wilson(correct: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval, clamped to 0 and 1; null for no rows."""
    p = correct / F.nullif(total, F.lit(0))
    middle, spread = (p + z * z / (2 * total)) / (1 + z * z / total), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return F.greatest(F.lit(0.0), middle - spread), F.least(F.lit(1.0), middle + spread)


def summary(rows: DataFrame, *groups: str) -> DataFrame:
    """Accuracy with its interval, majority share, errors and routing: what is forwarded and what relevant is lost."""
    hit = F.sum((F.col("gold") == F.col("predicted")).cast("int"))
    n = F.count("*")
    on = F.col("predicted").isin("RELEVANT", "NEEDS_CONTEXT")
    agg = rows.groupBy(*groups).agg(
        n.alias("n"), hit.alias("correct"), F.sum((F.col("predicted") == "ERROR").cast("int")).alias("errors"),
        F.greatest(*[F.sum((F.col("gold") == x).cast("int")) for x in LABELS]).alias("_most"), F.sum(on.cast("int")).alias("forwarded"),
        F.sum((F.col("gold") == "RELEVANT").cast("int")).alias("_relevant"), F.sum(((F.col("gold") == "RELEVANT") & on).cast("int")).alias("_kept"),
    )
    low, high = wilson(F.col("correct"), F.col("n"))
    return agg.select(*groups, "n", "correct", "errors", ratio(F.col("correct"), F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"), ratio(F.col("_most"), F.col("n")).alias("majority"), "forwarded", ratio(F.col("forwarded"), F.col("n")).alias("coverage"), ratio(F.col("_kept"), F.col("_relevant")).alias("relevant_recall"), (F.col("_relevant") - F.col("_kept")).alias("missed_relevant"))


def macro(classes: DataFrame, *groups: str) -> DataFrame:
    """Means over the labels with support, support-weighted F1, balanced accuracy and the labels of low support, absent ones included."""
    live = F.col("support") > 0
    mean = lambda c: F.avg(F.when(live, F.coalesce(c, F.lit(0.0))))
    weight = F.sum(F.when(live, F.coalesce("f1", F.lit(0.0)) * F.col("support"))) / F.nullif(F.sum("support"), F.lit(0))
    low = F.array_join(F.sort_array(F.collect_list(F.when(F.col("support") < LOW_SUPPORT, F.col("label")))), ",")
    return classes.groupBy(*groups).agg(mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"), weight.alias("weighted_f1"), mean("recall").alias("balanced_accuracy"), low.alias("low_support"))


def contract_macro(rows: DataFrame, groups: list[str], contract: str) -> DataFrame:
    """Mean over contracts of their macro F1, each over the labels its whole group has; an undefined score counts 0."""
    each = by_class(rows, *groups, contract)
    known = by_class(rows, *groups).where("support > 0").select(*groups, "label")
    one = each.join(known, [*groups, "label"]).groupBy(*groups, contract).agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("m"))
    return one.groupBy(*groups).agg(F.avg("m").alias("contract_macro_f1"), F.count("*").alias("contracts"))


def bootstrap(rows: DataFrame, contract: str, cluster: str, reps: int = 500) -> DataFrame:
    """Accuracy interval by resampling clusters within contracts; a cluster's draws come from an md5 of place and round.

    Clusters are summed first, so a round costs a row per cluster and the number of rows is never
    multiplied. Percentiles are taken by index over all rounds.
    """
    sums = rows.groupBy(contract, cluster).agg(F.sum((F.col("gold") == F.col("predicted")).cast("long")).alias("hit"), F.count("*").alias("n"))
    w = Window.partitionBy(contract).orderBy(cluster)
    sums = sums.withColumn("i", F.row_number().over(w) - 1).withColumn("k", F.count("*").over(Window.partitionBy(contract)))
    draws = sums.select(contract, "k", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(contract).cast("string"), F.col("slot").cast("string"), F.col("rep").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("k")
    took = draws.withColumn("i", pick).join(sums.select(contract, "i", "hit", "n"), [contract, "i"])
    each = took.groupBy("rep").agg((F.sum("hit") / F.sum("n")).alias("value"))
    v = F.sort_array(F.collect_list("value"))
    at = lambda q: F.element_at(v, F.floor((F.count("*") - 1) * q).cast("int") + 1)
    return each.agg(at(0.025).alias("low"), at(0.5).alias("middle"), at(0.975).alias("high"), F.count("*").alias("reps"))


def bootstrap_macro(rows: DataFrame, groups: list[str], contract: str, cluster: str, reps: int = 500) -> DataFrame:
    """Interval of the macro F1 of each group by resampling its clusters within contracts.

    Clusters are summed up to nine counts each before they are drawn. A group of fewer than two
    rows or clusters has no interval, nor has one where under 95 % of the rounds are defined.
    """
    cells = [F.sum(((F.col("gold") == g) & (F.col("predicted") == p)).cast("long")).alias(f"c{i}{j}") for i, g in enumerate(LABELS) for j, p in enumerate(LABELS)]
    support = [F.sum((F.col("gold") == g).cast("long")).alias(f"s{i}") for i, g in enumerate(LABELS)]
    sums = rows.groupBy(*groups, contract, cluster).agg(*cells, *support, F.count("*").alias("n"))
    by = Window.partitionBy(*groups, contract)
    sums = sums.withColumn("i", F.row_number().over(by.orderBy(cluster)) - 1).withColumn("k", F.count("*").over(by))
    draws = sums.select(*groups, contract, "k", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(contract).cast("string"), F.col("slot").cast("string"), F.col("rep").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("k")
    names = [f"c{i}{j}" for i in range(3) for j in range(3)] + ["s0", "s1", "s2"]
    took = draws.withColumn("i", pick).join(sums.select(*groups, contract, "i", *names), [*groups, contract, "i"])
    each = took.groupBy(*groups, "rep").agg(*[F.sum(n).alias(n) for n in names])
    labels = sums.groupBy(*groups).agg(*[(F.sum(f"s{i}") > 0).alias(f"h{i}") for i in range(3)], F.count("*").alias("clusters"), F.sum("n").alias("total"))
    each = each.join(labels, groups)
    f1 = lambda i: F.coalesce(ratio(2 * F.col(f"c{i}{i}"), F.col(f"s{i}") + sum((F.col(f"c{j}{i}") for j in range(3)), F.lit(0))), F.lit(0.0))
    held = sum((F.col(f"h{i}").cast("int") for i in range(3)), F.lit(0))
    value = sum((F.when(F.col(f"h{i}"), f1(i)).otherwise(0.0) for i in range(3)), F.lit(0.0)) / F.nullif(held, F.lit(0))
    values = F.sort_array(F.collect_list(value))
    at = lambda q: F.element_at("v", F.floor((F.size("v") - 1) * q).cast("int") + 1)
    out = each.groupBy(*groups).agg(values.alias("v"), F.max("clusters").alias("clusters"), F.max("total").alias("total"))
    sound = (F.col("clusters") >= 2) & (F.col("total") >= 2) & (F.size("v") >= 0.95 * reps)
    return out.select(*groups, F.when(sound, at(0.025)).alias("macro_low"), F.when(sound, at(0.975)).alias("macro_high"), "clusters")


def multiset_match(expected: DataFrame, found: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """For each case how many signatures agree, as multisets, with precision, recall and F1 (0 where undefined)."""
    a = expected.groupBy(*keys, signature).agg(F.count("*").alias("e"))
    b = found.groupBy(*keys, signature).agg(F.count("*").alias("f"))
    both = a.join(b, [*keys, signature], "full").groupBy(*keys).agg(F.sum(F.least(F.coalesce("e", F.lit(0)), F.coalesce("f", F.lit(0)))).alias("matched"), F.sum(F.coalesce("e", F.lit(0))).alias("expected"), F.sum(F.coalesce("f", F.lit(0))).alias("found"))
    z = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    return both.withColumns({"precision": z(F.col("matched"), F.col("found")), "recall": z(F.col("matched"), F.col("expected")), "f1": z(2 * F.col("matched"), F.col("found") + F.col("expected"))})


def agreement(expected: DataFrame, found: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """multiset_match at each level (exact, core, logical): a row a case and level, with totals to add up.

    expected and found have a column a level. failed(keys): cases whose answer was an error; their
    found rules count, and match nothing.
    """
    bad = failed.select(*keys).distinct().withColumn("_failed", F.lit(True)) if failed is not None else None
    if bad is not None:
        found = found.join(bad, keys, "left")
    spread = lambda df, mark: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.when(mark, F.lit(None).cast("string")).otherwise(F.col(level)).alias("signature")) for level in LEVELS])).alias("s")).select(*keys, "s.*")
    mark = F.coalesce(F.col("_failed"), F.lit(False)) if bad is not None else F.lit(False)
    return multiset_match(spread(expected, F.lit(False)), spread(found, mark), [*keys, "level"])


LEVELS = ("exact", "core", "logical")
WEIGHTS = {"kind": 4, "action": 4, "actor": 2, "asset": 2, "conditions": 1}
OPTIONAL = {"issuer": 1, "requires": 1, "remedies": 1}  # compared where either side has one
MOST_RULES = 16


def components(a: dict, b: dict) -> dict[str, bool]:
    """What of two rules agrees, part by part."""
    parts = [*WEIGHTS, *(k for k in OPTIONAL if a.get(k) is not None or b.get(k) is not None)]
    return {k: a.get(k) == b.get(k) for k in parts}


def align(expected: list[dict], found: list[dict]) -> list[tuple[int, int | None]]:
    """One-to-one assignment of the greatest agreement: a thousand for equal rules, else the weight of equal parts."""
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules to align")
    weight = WEIGHTS | OPTIONAL

    def worth(a: dict, b: dict) -> int:
        told = components(a, b)
        return sum(weight[k] for k, equal in told.items() if equal) + 1000 * all(told.values())

    best: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for i, a in enumerate(expected):
        after = {}
        for used, (score, pairs) in best.items():
            for j in (None, *range(len(found))):
                if j is not None and used >> j & 1:
                    continue
                key = used if j is None else used | 1 << j
                new = (score + (0 if j is None else worth(a, found[j])), (*pairs, (i, j)))
                if key not in after or new[0] > after[key][0]:
                    after[key] = new
        best = after
    return list(max(best.values(), key=lambda x: x[0])[1])


def aligned(rows: DataFrame) -> DataFrame:
    """contract_id, expected_id, found_id (null: no partner), complete, and a boolean each for kind, action, actor, asset, conditions, issuer, requires, remedies (null where neither side has it).

    rows: contract_id, rule_id, side (expected or found), kind, action, actor, asset, conditions, and
    where there are any issuer, requires, remedies. Rules that agree as a whole are paired first, by a
    join of their places among equals; no assignment is worth more without such a pair. Only what is
    left is assigned, sixteen found rules an agreement at most; where more are left it has an error.
    """
    import pandas as pd

    parts = [*WEIGHTS, *OPTIONAL]
    rows = rows.select("contract_id", "rule_id", "side", *[F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in parts])
    whole = F.sha2(F.to_json(F.struct(*parts)), 256)
    place = F.row_number().over(Window.partitionBy("contract_id", "side", "whole").orderBy("rule_id"))
    rows = rows.withColumn("whole", whole).withColumn("place", place)
    sides = [rows.where(F.col("side") == s).select("contract_id", "whole", "place", F.col("rule_id").alias(f"{s}_id"), F.struct(*parts).alias(s)) for s in ("expected", "found")]
    both = sides[0].join(sides[1], ["contract_id", "whole", "place"], "full")
    equal = both.where("expected_id is not null and found_id is not null").select("contract_id", "expected_id", "found_id", F.lit(True).alias("complete"), *[(F.lit(True) if c in WEIGHTS else F.when(F.col(f"expected.{c}").isNotNull(), True)).alias(c) for c in parts], F.lit(None).cast("string").alias("error"))
    left = both.where("expected_id is null or found_id is null").select("contract_id", F.coalesce("expected_id", "found_id").alias("rule_id"), F.when(F.col("expected_id").isNotNull(), "expected").otherwise("found").alias("side"), F.coalesce("expected", "found").alias("r")).select("contract_id", "rule_id", "side", "r.*")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {s: [{k: v if isinstance(v, str) else None for k, v in x.items()} for x in pdf[pdf["side"] == s].to_dict("records")] for s in ("expected", "found")}
        e, f = held["expected"], held["found"]
        error = f"more than {MOST_RULES} rules to align" if len(f) > MOST_RULES else None
        pairs = [(i, None) for i in range(len(e))] if error else align(e, f)
        pairs += [(None, j) for j in range(len(f)) if j not in {j for _, j in pairs}]
        out = []
        for i, j in pairs:
            told = components(e[i], f[j]) if i is not None and j is not None else {}
            out.append([pdf["contract_id"].iloc[0], None if i is None else e[i]["rule_id"], None if j is None else f[j]["rule_id"], bool(told) and all(told.values()), *(told.get(k, False if k in WEIGHTS else None) for k in parts), error])
        return pd.DataFrame(out, columns=["contract_id", "expected_id", "found_id", "complete", *parts, "error"])

    schema = "contract_id string, expected_id string, found_id string, complete boolean, " + ", ".join(f"{k} boolean" for k in parts) + ", error string"
    return equal.unionByName(map_groups(left, "contract_id", ["side", "rule_id"], walk, schema))


def component_agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of `aligned` rows: a row a part with matched, expected, found, precision, recall, F1."""
    z = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("equal"), (F.lit(True) if c in WEIGHTS else F.col(c).isNotNull()).alias("there")) for c in (*WEIGHTS, *OPTIONAL)]))
    rows = pairs.select(*keys, "expected_id", "found_id", named.alias("s")).select(*keys, "expected_id", "found_id", "s.*").where("there")
    each = rows.groupBy(*keys, "part").agg(F.sum(F.coalesce("equal", F.lit(False)).cast("long")).alias("matched"), F.count("expected_id").alias("expected"), F.count("found_id").alias("found"))
    return each.withColumns({"precision": z(F.col("matched"), F.col("found")), "recall": z(F.col("matched"), F.col("expected")), "f1": z(2 * F.col("matched"), F.col("found") + F.col("expected"))})
