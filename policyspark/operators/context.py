"""Clause structure and evidence: scopes, parents, references, definitions, introductions, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.functions import text as tx
from policyspark.functions.shared import settled

PRIORITY = {"parent": 0, "definition": 1, "other": 2, "reference": 3, "retrieved": 4}


def scoped(clauses: DataFrame) -> DataFrame:
    """scope: one more at each annex heading and where top numbers start again at 1."""
    by = Window.partitionBy("contract_id").orderBy("ord")
    annex = F.coalesce(tx.scope_heading(F.col("heading")).isNotNull(), F.lit(False)).cast("int")
    top = F.nullif(F.regexp_extract(F.coalesce("clause_id", F.lit("")), r"^(\d+)", 1), F.lit(""))
    rows = clauses.withColumn("_annex", annex).withColumn("_seg", F.sum("_annex").over(by)).withColumn("_top", top)
    before = Window.partitionBy("contract_id", "_seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_prev", F.last("_top", ignorenulls=True).over(before))
    step = F.col("_annex") + F.coalesce(((F.col("_top") == "1") & F.col("_prev").isNotNull() & (F.col("_prev") != "1")).cast("int"), F.lit(0))
    return rows.withColumn("_step", step).withColumn("scope", F.sum("_step").over(by).cast("int")).drop("_annex", "_seg", "_top", "_prev", "_step")


def unique_numbers(scoped_rows: DataFrame) -> DataFrame:
    """Clauses whose number is the only one of its scope."""
    n = F.count("*").over(Window.partitionBy("contract_id", "scope", "clause_id"))
    return scoped_rows.where("clause_id is not null").withColumn("_n", n).where("_n = 1").select("contract_id", "scope", F.col("clause_id").alias("target_clause"), F.col("ord").alias("target_ord"))


def ancestry(scoped_rows: DataFrame) -> DataFrame:
    """(contract_id, scope, ord, clause_id, level, target_clause, target_ord): every number above a clause that exists once in its scope, level 1 the nearest in the numbering."""
    up = scoped_rows.where("clause_id is not null").select("contract_id", "scope", "ord", "clause_id", F.posexplode(tx.ancestors(F.col("clause_id"))).alias("level", "target_clause"))
    return up.join(unique_numbers(scoped_rows), ["contract_id", "scope", "target_clause"]).select("contract_id", "scope", "ord", "clause_id", (F.col("level") + 1).alias("level"), "target_clause", "target_ord")


def parents(scoped_rows: DataFrame) -> DataFrame:
    """The nearest clause above in the numbering that exists once in the scope."""
    return ancestry(scoped_rows).groupBy("contract_id", "scope", "ord", "clause_id").agg(F.min_by("target_clause", "level").alias("parent_clause"), F.min_by("target_ord", "level").alias("parent_ord"))


def descendants(scoped_rows: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs over all levels: a clause's unique parent, that one's, and so on."""
    return ancestry(scoped_rows).select("contract_id", "scope", F.col("target_clause").alias("ancestor"), F.col("target_ord").alias("ancestor_ord"), F.col("clause_id").alias("descendant"), "ord")


def conversation_closure(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, above, root): how many turns are reached from each by going one turn back at a time, and the first of them.

    A run of consecutive turns is an island of its conversation: no pair of turns is ever made, so
    a long conversation costs a row a turn.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    island = F.col("turn") - F.row_number().over(by)
    rows = turns.select("conv_id", "turn").where(F.col("turn").isNotNull()).distinct().withColumn("island", island)
    rows = rows.withColumn("root", F.min("turn").over(Window.partitionBy("conv_id", "island")))
    return rows.where("turn > root").select("conv_id", "turn", (F.col("turn") - F.col("root")).cast("long").alias("above"), "root")


def sections(scoped_rows: DataFrame) -> DataFrame:
    """(contract_id, annex, annex_scope, annexes): each annex name with its scope and how many headings have it."""
    heads = scoped_rows.select("contract_id", "scope", tx.scope_heading(F.col("heading")).alias("annex")).where("annex is not null")
    return heads.groupBy("contract_id", "annex").agg(F.min("scope").alias("annex_scope"), F.count("*").alias("annexes"))


def _inherited(cites: DataFrame, up: DataFrame) -> DataFrame:
    """cites(contract_id, src_ord, ...) of each clause and of the clauses above it."""
    own = cites.withColumn("ord", F.col("src_ord"))
    above = cites.join(up.select("contract_id", "ord", F.col("target_ord").alias("src_ord")), ["contract_id", "src_ord"])
    return own.unionByName(above)


def citations(scoped_rows: DataFrame) -> DataFrame:
    """Each citation of a clause's own text: src_ord, seq, found, numbers, kind (external, main, annex or plain), annex, broken range.

    What stands 70 characters before and 100 after decides what law or section is meant.
    """
    rows = scoped_rows.where(F.col("text").rlike(tx.REFERENCE)).select("contract_id", "scope", F.col("ord").alias("src_ord"), F.posexplode(tx.matches(F.col("text"), tx.REFERENCE, 1)).alias("seq", "m"))
    after, before = F.col("m.after100"), F.col("m.before70")
    annex = F.upper(F.regexp_extract(after, tx.ANNEX_AFTER, 1))
    kind = F.when(after.rlike(tx.LAW_AFTER) | before.rlike(tx.LAW_BEFORE), "external").when(annex != "", "annex").when(after.rlike(tx.MAIN_AFTER), "main").otherwise("plain")
    numbers = tx.spread(F.col("m.part"))
    broken = tx.ranged(F.col("m.part")) & (F.size(numbers) == 2) & ~F.coalesce(_next(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))), F.lit(False))
    return rows.select("contract_id", "scope", "src_ord", "seq", F.col("m.found").alias("found"), numbers.alias("numbers"), kind.alias("kind"), F.when(annex != "", annex).alias("annex"), broken.alias("broken"))


def _next(a: Column, b: Column) -> Column:
    """Whether b follows a by one under the same stem, so that the two are their own range."""
    last = lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("int")
    return (F.regexp_extract(a, r"^(.*?)\d+$", 1) == F.regexp_extract(b, r"^(.*?)\d+$", 1)) & (last(b) == last(a) + 1)


def references(scoped_rows: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Numbers each clause and the clauses above it cite, with what they lead to.

    outcome: resolved, missing, ambiguous, external (a law), section (an annex that is missing or
    not the only one of its name), range (two numbers that are none; both are still looked up).
    A number is looked up in the citing clause's scope, else in the main one of that scope; `of the
    agreement` means the main scope alone, `of Annex A` that annex alone.
    """
    main = main_scopes(scoped_rows)
    cited = _inherited(citations(scoped_rows), ancestry(scoped_rows) if up is None else up).join(main, ["contract_id", "scope"]).join(sections(scoped_rows), ["contract_id", "annex"], "left")
    lost = (F.col("kind") == "annex") & (F.coalesce("annexes", F.lit(0)) != 1)
    none = F.lit(None).cast("int")
    first = F.when(F.col("kind") == "main", F.col("main_scope")).when(F.col("kind") == "annex", F.col("annex_scope")).otherwise(F.col("scope"))
    second = F.when((F.col("kind") == "plain") & (F.col("main_scope") != F.col("scope")), F.col("main_scope")).otherwise(none)
    base = ["contract_id", "scope", "ord", "src_ord", "seq"]
    told = F.array_compact(F.array(F.when(F.col("kind") == "external", F.struct(F.col("found").alias("number"), F.lit("external").alias("outcome"))), F.when(lost & (F.col("kind") != "external"), F.struct(F.col("annex").alias("number"), F.lit("section").alias("outcome"))), F.when(F.col("broken") & (F.col("kind") != "external") & ~lost, F.struct(F.col("found").alias("number"), F.lit("range").alias("outcome")))))
    notes = cited.select(*base, F.explode(told).alias("t")).select(*base, "t.number", "t.outcome", none.alias("target_ord"))
    live = cited.where((F.col("kind") != "external") & ~lost).select(*base, F.posexplode("numbers").alias("place", "number"), first.alias("first"), second.alias("second"))
    n = scoped_rows.where("clause_id is not null").groupBy("contract_id", "scope", "clause_id").agg(F.count("*").alias("n"), F.min("ord").alias("target_ord"))
    side = lambda name: n.select("contract_id", F.col("scope").alias(name), F.col("clause_id").alias("number"), F.col("n").alias(f"{name}_n"), F.col("target_ord").alias(f"{name}_ord"))
    found = live.join(side("first"), ["contract_id", "first", "number"], "left").join(side("second"), ["contract_id", "second", "number"], "left")
    count, target = F.coalesce("first_n", "second_n"), F.coalesce("first_ord", "second_ord")
    outcome = F.when(count.isNull(), "missing").when(count > 1, "ambiguous").otherwise("resolved")
    return found.select(*base, "number", outcome.alias("outcome"), F.when(outcome == "resolved", target).alias("target_ord")).unionByName(notes)


def annex_mentions(scoped_rows: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Annexes that a clause or one above it names otherwise than as the place of a cited number: annex, annex_scope, outcome (resolved, own, section)."""
    text = F.col("text")
    places = F.transform(F.filter(tx.matches(text, tx.REFERENCE, 1), lambda m: m["after100"].rlike(tx.ANNEX_AFTER) & ~(m["after100"].rlike(tx.LAW_AFTER) | m["before70"].rlike(tx.LAW_BEFORE))), lambda m: m["start"] + F.length(m["found"]) + F.length(F.regexp_extract(m["after100"], tx.ANNEX_AFTER, 0)) - F.length(F.regexp_extract(m["after100"], tx.ANNEX_AFTER, 1)))
    named = F.filter(tx.matches(text, rf"(?i)\b{tx.ANNEX}\b"), lambda m: ~F.array_contains(places, m["start"]))
    rows = scoped_rows.where(text.rlike(rf"(?i)\b{tx.ANNEX}\b")).select("contract_id", "scope", F.col("ord").alias("src_ord"), F.explode(F.array_distinct(F.transform(named, lambda m: F.upper(m["found"])))).alias("annex"))
    cited = _inherited(rows, ancestry(scoped_rows) if up is None else up).select("contract_id", "scope", "ord", "annex").distinct().join(sections(scoped_rows), ["contract_id", "annex"], "left")
    outcome = F.when(F.coalesce("annexes", F.lit(0)) != 1, "section").when(F.col("annex_scope") == F.col("scope"), "own").otherwise("resolved")
    return cited.select("contract_id", "scope", "ord", "annex", F.when(outcome == "resolved", F.col("annex_scope")).alias("annex_scope"), outcome.alias("outcome"))


def annex_references(scoped_rows: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Clauses that name an annex, with all clauses of its scope; never of their own."""
    cite = annex_mentions(scoped_rows, up).where("outcome = 'resolved'").select("contract_id", "ord", "annex", F.col("annex_scope").alias("scope"))
    return cite.join(scoped_rows.select("contract_id", "scope", F.col("ord").alias("target_ord")), ["contract_id", "scope"]).select("contract_id", "ord", "annex", "target_ord")


def definitions(scoped_rows: DataFrame) -> DataFrame:
    """Every defined term: contract_id, scope, def_ord, n (its place in the clause), term, name (folded), def_text, by_means.

    A definition goes to where the next one of its clause begins. Terms with digits, annex headings
    and empty form fields are none.
    """
    body = tx.after_number(F.col("text"))
    rows = scoped_rows.where(body.rlike(tx.DEFINITION)).select("contract_id", "scope", F.col("ord").alias("def_ord"), F.posexplode(tx.matches(body, tx.DEFINITION, 1)).alias("n", "m"))
    after = F.col("m.after")
    blank = ~F.regexp_replace(after, r"[_\[\].\-]", "").rlike(r"\w") | after.rlike(r"^\s*[_.]{3,}")
    kept = rows.where(~F.col("m.part").rlike(r"\d") & tx.scope_heading(F.col("m.found")).isNull() & ~blank)
    text = tx.stripped(F.concat("m.found", "m.after"))
    return kept.select("contract_id", "scope", "def_ord", "n", F.col("m.part").alias("term"), name_of(F.col("m.part")).alias("name"), text.alias("def_text"), F.regexp_extract(text, r"^([^\n]*)", 1).rlike(tx.PRECISE).alias("by_means"))


def name_of(text: Column) -> Column:
    """Text as terms are looked up: lower case, white space single."""
    return F.lower(F.regexp_replace(tx.stripped(text), r"\s+", " "))


def _marked(name: Column) -> Column:
    """Every run of word characters closed on both sides, so that what contains a name has it as whole words."""
    return F.regexp_replace(name, r"(?U)(\w+)", "\u0001$1\u0001")


def mentions(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows' other columns with each `name` of names(contract_id, name) that the text column holds as whole words.

    A contract's distinct names are one array that meets its texts by equality of the contract;
    each text is folded once and the array filtered in place, so rows are only made for hits.
    """
    known = names.groupBy("contract_id").agg(F.collect_set(F.struct(_marked(F.col("name")).alias("m"), "name")).alias("_names"))
    kept = [c for c in rows.columns if c != column]
    found = rows.join(known, "contract_id").withColumn("_text", _marked(name_of(F.col(column))))
    return found.select(*kept, F.explode(F.filter("_names", lambda x: F.contains(F.col("_text"), x["m"]))["name"]).alias("name"))


def chosen(scoped_rows: DataFrame) -> DataFrame:
    """For each scope and name the one definition that counts there: contract_id, scope, name, def_ord, n, def_text; or how it is ambiguous.

    Those of the scope come before those of its main scope, and none from elsewhere; among them
    those that say `means` come first. More than one left is ambiguous: candidates > 1.
    """
    defs, main = definitions(scoped_rows), main_scopes(scoped_rows)
    where = main.select("contract_id", F.col("scope").alias("use_scope"), "scope", F.lit(0).alias("far")).unionByName(main.where("main_scope <> scope").select("contract_id", F.col("scope").alias("use_scope"), F.col("main_scope").alias("scope"), F.lit(2).alias("far")))
    rows = defs.join(where, ["contract_id", "scope"]).withColumn("rank", F.col("far") + F.when(F.col("by_means"), 0).otherwise(1))
    best = rows.groupBy("contract_id", "use_scope", "name").agg(F.min("rank").alias("best"), F.min_by(F.struct("def_ord", "n", "def_text", "term"), F.struct("rank", "def_ord", "n")).alias("d"), F.collect_list("rank").alias("ranks"))
    return best.select("contract_id", F.col("use_scope").alias("scope"), "name", "d.def_ord", "d.n", "d.def_text", "d.term", F.size(F.filter("ranks", lambda r: r == F.col("best"))).alias("candidates"))


def definition_uses(scoped_rows: DataFrame) -> DataFrame:
    """Clauses with each defined term their text holds, as whole words in any case, and its definition. Ambiguous ones attach nothing."""
    picked = settled(chosen(scoped_rows))
    found = mentions(scoped_rows.select("contract_id", "scope", "ord", "text"), "text", picked)
    return found.join(picked.where("candidates = 1"), ["contract_id", "scope", "name"]).where("ord <> def_ord").select("contract_id", "scope", "ord", "term", "name", "def_ord", "n", "def_text")


def name_closure(picked: DataFrame) -> DataFrame:
    """(contract_id, scope, name, reached): the names that a name's definition, the definitions of its names and so on hold, itself included.

    Paths double in length each round, so a chain of n definitions takes about log2(n) rounds; what
    each finds goes to the shared folder, and only that is joined with what is known.
    """
    held = mentions(picked.where("candidates = 1").select("contract_id", "scope", F.col("name").alias("from"), "def_text"), "def_text", picked)
    step = held.select("contract_id", "scope", F.col("from").alias("name"), F.col("name").alias("reached")).where("name <> reached")
    known = settled(step.join(picked.where("candidates = 1").select("contract_id", "scope", F.col("name").alias("reached")), ["contract_id", "scope", "reached"]).select("contract_id", "scope", "name", "reached").distinct())
    new = known
    while not new.isEmpty():
        far = new.select("contract_id", "scope", F.col("name").alias("reached"), F.col("reached").alias("further"))
        near = known.select("contract_id", "scope", "name", "reached")
        more = near.join(far, ["contract_id", "scope", "reached"]).select("contract_id", "scope", "name", F.col("further").alias("reached")).where("name <> reached")
        new = settled(more.distinct().join(known, ["contract_id", "scope", "name", "reached"], "left_anti"))
        known = known.unionByName(new)  # a union of a few tables that are settled already
    itself = picked.where("candidates = 1").select("contract_id", "scope", "name", F.col("name").alias("reached"))
    return known.unionByName(itself)


def definition_closure(scoped_rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Definitions a clause needs, those its definitions need included: contract_id, ord, def_ord, n, def_text.

    texts(contract_id, scope, ord, text): what each clause is read with; its own text if not given.
    """
    picked = settled(chosen(scoped_rows))
    rows = scoped_rows.select("contract_id", "scope", "ord", "text") if texts is None else texts
    used = mentions(rows, "text", picked).select("contract_id", "scope", "ord", "name").distinct()
    reach = used.join(name_closure(picked), ["contract_id", "scope", "name"]).select("contract_id", "scope", "ord", F.col("reached").alias("name")).distinct()
    return reach.join(picked.where("candidates = 1"), ["contract_id", "scope", "name"]).where("ord <> def_ord").select("contract_id", "ord", "name", "def_ord", "n", "def_text")


def page_notes(rows: DataFrame, pattern: str) -> DataFrame:
    """Lines of a page with the note that the page carries once."""
    notes = rows.where(F.col("text").rlike(pattern)).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("pos").alias("note_pos")).where("n = 1").drop("n")
    return rows.join(notes, ["doc_id", "page"]).where("pos <> note_pos").select("doc_id", "page", "pos", "note_pos")


def introductions(blocks: DataFrame) -> DataFrame:
    """For each table block the nearest earlier block that is neither table nor other."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.when(~F.col("block_type").isin("table", "other"), F.col("ord"))
    return blocks.withColumn("intro_ord", F.last(plain, ignorenulls=True).over(w)).where("block_type = 'table'").select("doc_id", "ord", "intro_ord")


def table_groups(blocks: DataFrame) -> DataFrame:
    """Runs of consecutive table blocks; another page opens a new one."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    new = (F.col("block_type") == "table") & ((F.lag("block_type").over(w) != "table") | (F.lag("page").over(w) != F.col("page")) | F.lag("ord").over(w).isNull())
    return blocks.withColumn("_new", new.cast("int")).withColumn("table_group", F.sum("_new").over(w)).where("block_type = 'table'").select("doc_id", "ord", "table_group")


def main_scopes(scoped_rows: DataFrame) -> DataFrame:
    """For each scope the last one up to it that no annex heading opened."""
    scopes = scoped_rows.groupBy("contract_id", "scope").agg(F.max(F.coalesce(tx.scope_heading(F.col("heading")).isNotNull(), F.lit(False)).cast("int")).alias("annexed"))
    w = Window.partitionBy("contract_id").orderBy("scope")
    return scopes.withColumn("main_scope", F.last(F.when(F.col("annexed") == 0, F.col("scope")), ignorenulls=True).over(w)).select("contract_id", "scope", "main_scope")


def block_owners(clauses: DataFrame) -> DataFrame:
    """(contract_id, block_id, ord): the clauses that each block went into."""
    return clauses.select("contract_id", F.explode("block_ids").alias("block_id"), "ord").distinct()


def disclaimers(clauses: DataFrame) -> DataFrame:
    """(contract_id, ord, target_ord): for every clause those that say of its page that it is no agreement."""
    pages = clauses.select("contract_id", "ord", F.explode("pages").alias("page")).distinct()
    notes = clauses.where(F.col("text").rlike(tx.DISCLAIMER)).select("contract_id", F.col("ord").alias("target_ord"), F.explode("pages").alias("page")).distinct()
    return pages.join(notes, ["contract_id", "page"]).where("ord <> target_ord").select("contract_id", "ord", "target_ord").distinct()


def table_context(blocks: DataFrame, clauses: DataFrame) -> DataFrame:
    """(contract_id, ord, target_ord): for clauses out of a table the clauses of their row, of the table's headers and of the text that introduces it.

    blocks: contract_id, ord, block_id, page, block_type, text, y0 and, where extraction knows them,
    table_id, table_row, table_header. A run of table blocks of one page and table is a table. Of a
    known table only blocks of a known row, and headers, count; else rows are told by base lines
    that lie over three points apart, and the first is the header unless it obliges someone.
    """
    extra = {"table_id": "string", "table_row": "int", "table_header": "boolean"}
    rows = blocks.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in blocks.columns})
    by = Window.partitionBy("contract_id").orderBy("ord")
    table = F.col("block_type") == "table"
    moved = ~F.lag("page").over(by).eqNullSafe(F.col("page")) | ~F.lag("table_id").over(by).eqNullSafe(F.col("table_id"))
    new = table & (F.coalesce(F.lag("block_type").over(by) != "table", F.lit(True)) | moved)
    plain = F.when(~F.col("block_type").isin("table", "other"), F.col("block_id"))
    rows = rows.withColumn("table_group", F.sum(new.cast("int")).over(by)).withColumn("intro", F.last(plain, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).where(table)
    header = F.coalesce("table_header", F.lit(False))
    held = rows.where(F.col("table_id").isNull() | F.col("table_row").isNotNull() | header)
    one = F.struct("ord", "block_id", "table_row", "y0", header.alias("header"), "text")
    groups = held.groupBy("contract_id", "table_group").agg(F.sort_array(F.collect_list(one)).alias("bs"), F.first("table_id").alias("table_id"), F.min_by("intro", "ord").alias("intro"))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("int").alias("t"), F.array().cast("array<struct<block_id:string,row:int,header:boolean,text:string>>").alias("out"))

    def step(acc, x):
        next_ = (acc["row"] < 0) | ~acc["t"].eqNullSafe(x["table_row"]) | F.coalesce(F.abs(x["y0"] - acc["y"]) > 3, F.lit(False))
        row = F.when(next_, acc["row"] + 1).otherwise(acc["row"])
        made = F.struct(x["block_id"].alias("block_id"), row.alias("row"), x["header"].alias("header"), x["text"].alias("text"))
        return F.struct(row.alias("row"), F.when(next_, x["y0"].cast("double")).otherwise(acc["y"]).alias("y"), F.when(next_, x["table_row"]).otherwise(acc["t"]).alias("t"), F.concat(acc["out"], F.array(made)).alias("out"))

    groups = groups.withColumn("rs", F.aggregate("bs", zero, step, lambda acc: acc["out"]))
    first = F.filter("rs", lambda x: x["row"] == 0)
    bare = F.col("table_id").isNull() & ~F.exists("rs", lambda x: x["header"]) & ~F.array_join(F.transform(first, lambda x: x["text"]), " ").rlike(tx.HEADER_STOP)
    heads = F.when(bare, first).otherwise(F.filter("rs", lambda x: x["header"]))
    ids = lambda xs: F.transform(xs, lambda x: x["block_id"])
    groups = groups.withColumn("always", F.array_distinct(F.concat(ids(heads), F.array_compact(F.array("intro")))))
    members = groups.select("contract_id", "always", "rs", F.explode("rs").alias("r"))
    near = ids(F.filter("rs", lambda x: x["row"] == F.col("r.row")))
    pairs = members.select("contract_id", F.col("r.block_id").alias("block_id"), F.explode(F.array_distinct(F.concat("always", near))).alias("other"))
    owners = block_owners(clauses)
    found = pairs.join(owners, ["contract_id", "block_id"]).join(owners.select("contract_id", F.col("block_id").alias("other"), F.col("ord").alias("target_ord")), ["contract_id", "other"])
    return found.where("ord <> target_ord").select("contract_id", "ord", "target_ord").distinct()


def edges(scoped_rows: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """All evidence of each clause: contract_id, ord, target_ord, relationship, priority, n and def_text for a definition.

    In this order, the first to reach a target counts: attached(contract_id, ord, target_ord), that
    is table rows, headers, introductions and page notes, as `other`; all parents; descendants of
    clauses that are no mere headings, as `other`; what the clause and its parents cite, each with
    its descendants, and the clauses of annexes they name, as `reference`. Definitions are those of
    the terms of all these texts, followed through to the end; one that is a whole clause counts once.
    """
    up = settled(ancestry(scoped_rows))
    ord_of = lambda df, kind, seq: df.select("contract_id", "ord", "target_ord", F.lit(kind).alias("relationship"), F.lit(seq).alias("seq"))
    kinds = [ord_of(up, "parent", 1)]
    if attached is not None:
        kinds.append(ord_of(attached, "other", 0))
    once = unique_numbers(scoped_rows).select("contract_id", F.col("target_ord").alias("ord"))
    nearest = up.groupBy("contract_id", "ord").agg(F.min("level").alias("nearest"))
    twice = up.join(nearest, ["contract_id", "ord"]).where("level = nearest").join(once, ["contract_id", "ord"], "left_anti").select("contract_id", "ord", "target_ord")
    heads = scoped_rows.where(tx.standalone_heading(F.col("heading"), F.col("text")) & ~F.rtrim("text").endswith(":")).select("contract_id", F.col("ord").alias("target_ord"))
    below = up.join(twice, ["contract_id", "ord", "target_ord"], "left_anti").join(heads, ["contract_id", "target_ord"], "left_anti")
    kinds.append(ord_of(below.select("contract_id", F.col("target_ord").alias("ord"), F.col("ord").alias("target_ord")), "other", 2))
    cited = settled(references(scoped_rows, up).where("outcome = 'resolved'").select("contract_id", "ord", "target_ord").distinct())
    under = cited.join(up.select("contract_id", "target_ord", F.col("ord").alias("deep")), ["contract_id", "target_ord"]).select("contract_id", "ord", F.col("deep").alias("target_ord"))
    kinds += [ord_of(cited, "reference", 3), ord_of(under, "reference", 3), ord_of(annex_references(scoped_rows, up), "reference", 4)]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    texts = scoped_rows.select("contract_id", "scope", "ord", "text")
    plain = settled(every.where("ord <> target_ord").groupBy("contract_id", "ord", "target_ord").agg(F.min_by("relationship", "seq").alias("relationship")))
    read = plain.join(texts.select("contract_id", F.col("ord").alias("target_ord"), "text"), ["contract_id", "target_ord"]).join(texts.drop("text"), ["contract_id", "ord"]).select("contract_id", "scope", "ord", "text")
    defs = definition_closure(scoped_rows, texts.unionByName(read))
    whole = texts.select("contract_id", F.col("ord").alias("def_ord"), F.col("text").alias("def_text"))
    again = defs.join(whole, ["contract_id", "def_ord", "def_text"], "left_semi").join(plain.select("contract_id", "ord", F.col("target_ord").alias("def_ord")), ["contract_id", "ord", "def_ord"], "left_semi").select("contract_id", "ord", "def_ord", "n")
    new = defs.join(again, ["contract_id", "ord", "def_ord", "n"], "left_anti").select("contract_id", "ord", F.col("def_ord").alias("target_ord"), F.lit("definition").alias("relationship"), "n", "def_text")
    out = plain.select("*", F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("def_text")).unionByName(new)
    return out.withColumn("priority", F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("relationship")))


def unresolved(scoped_rows: DataFrame) -> DataFrame:
    """(contract_id, ord, note): citations and sections of a clause that lead nowhere, and its terms whose definition is ambiguous."""
    up = settled(ancestry(scoped_rows))
    refs = references(scoped_rows, up).where("outcome <> 'resolved'").select("contract_id", "ord", F.concat_ws(" ", "outcome", "number").alias("note"))
    named = annex_mentions(scoped_rows, up).where("outcome = 'section'").select("contract_id", "ord", F.concat_ws(" ", "outcome", "annex").alias("note"))
    picked = settled(chosen(scoped_rows))
    unclear = mentions(scoped_rows.select("contract_id", "scope", "ord", "text"), "text", picked).join(picked.where("candidates > 1"), ["contract_id", "scope", "name"]).where("ord <> def_ord")
    return refs.unionByName(named).unionByName(unclear.select("contract_id", "ord", F.concat_ws(" ", F.lit("definition"), "name").alias("note"))).distinct()


def fit_budget(evidence: DataFrame, budget: int) -> DataFrame:
    """Evidence in priority order that fits a clause's budget of bytes: what does not fit is skipped, later pieces may still fit."""
    items = evidence.groupBy("contract_id", "ord").agg(F.sort_array(F.collect_list(F.struct("priority", "target_ord", "bytes"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"))
    total = F.aggregate("items", zero, lambda acc, x: F.when(acc["used"] + x["bytes"] <= budget, F.struct((acc["used"] + x["bytes"]).alias("used"), (acc["kept"] + 1).alias("kept"))).otherwise(acc))
    return items.select("contract_id", "ord", total.alias("t"), F.size("items").alias("offered")).select("contract_id", "ord", F.col("t.used").alias("used"), F.col("t.kept").alias("kept"), F.col("offered").cast("long").alias("offered"))
