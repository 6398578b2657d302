"""Blocks to clauses as windows over lines: numbers, lists under them, what goes on from block to block, parents by scope.

A block is one of six things: outside the text, an annex heading, running text of a document without
numbers, a definition, a heading without a number, or lines. Only lines that carry a number or a
list mark start clauses within a block; what follows belongs to the clause that is open. All of an
agreement's windows share one partitioning and one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.functions import text as tx
from policyspark.operators import context

# What breaks lines, what a list mark looks like, marks that are roman numbers too, words before a number that cites, dots of a table of contents.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
LETTER = r"^\s*(?:\(([a-z]|[ivx]{2,4})\)|([a-z]|[ivx]{2,4})[.)])(?=\s|$)"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
CITES = r"(?i)\b(?:article|section|clause)s?\s*$"
NAMED = r"(?i)^\s*(?:article|section|clause)\b"
DOTS = r"\.{4}"

ORDER = ["ord", "line"]


def lines_of(blocks: DataFrame) -> DataFrame:
    """A row a line of blocks (contract_id, ord, block_id, page, block_type, text): line (its place), words, own (the number it begins with), role (of its block)."""
    text, kind = F.col("text"), F.col("block_type")
    first = tx.stripped(F.regexp_extract(text, r"^([^\n]*)", 1))
    split = F.split(text, BREAK)
    rows = blocks.withColumns({"first": first, "lines": split})
    numbers = F.transform("lines", lambda x: tx.clause_number(x))
    rows = rows.withColumn("numbers", numbers)
    by = Window.partitionBy("contract_id")
    counted = F.when(~kind.isin("other", "table"), F.filter("numbers", lambda x: x.isNotNull()))
    rows = rows.withColumn("counted", counted).withColumn("numbered", (F.sum(F.greatest(F.size("counted"), F.lit(0))).over(by) >= 2) | (F.max(F.coalesce(F.exists("counted", lambda x: x.contains(".")), F.lit(False)).cast("int")).over(by) == 1))
    annex = tx.scope_heading(text).isNotNull() & ((kind == "heading") | ((F.upper("first") == F.col("first")) & (F.lower("first") != F.col("first"))))
    titled = (kind == "heading") & ~F.exists("numbers", lambda x: x.isNotNull())
    role = (
        F.when(kind == "other", "outside").when(annex, "annex").when(~F.col("numbered"), "running")
        .when((kind != "table") & tx.clause_number(text).isNull() & text.rlike(tx.DEFINITION.replace("(?m)", "")), "definition").when(titled, "title").otherwise("lines")
    )
    rows = rows.withColumn("role", role)
    each = F.when(F.col("role") == "lines", F.col("lines")).otherwise(F.array("text"))
    rows = rows.select("contract_id", "ord", "block_id", "page", "block_type", "role", "first", F.size(each).alias("n"), F.posexplode(each).alias("line", "words"), "lines", "text")
    before = F.get("lines", F.col("line") - 1)
    number = tx.clause_number(F.col("words"))
    cited = ((kind != "heading") & F.col("words").rlike(NAMED)) | ((F.col("line") > 0) & (before.rlike(CITES) | ((F.col("line") == F.col("n") - 1) & F.col("words").rlike(r"^\s*[\d.()]+\s*$"))))
    never = (F.col("role") != "lines") | (kind == "table") | text.rlike(r"^\d+\s*$") | text.rlike(DOTS)
    return rows.select("contract_id", "ord", "line", "block_id", "page", "block_type", "role", "first", "words", F.when(~never & ~F.coalesce(cited, F.lit(False)), number).alias("own"))


def _levels(number: Column) -> Column:
    """The marks in brackets at the end of a number."""
    return F.regexp_extract_all(number, F.lit(r"\(([^)]+)\)"), F.lit(1))


def listed(lines: DataFrame) -> DataFrame:
    """Lines with number: their own, or that of a list item under the number before it; and section: the last own number, forgotten at an annex.

    A mark stays in the list of its number unless it opens or goes on in a roman one: an `i` under a
    letter other than h opens it, and roman marks go on in it until another letter comes.
    """
    by = Window.partitionBy("contract_id").orderBy(*ORDER)
    ends = F.col("role").isin("annex", "definition", "title")
    rows = lines.withColumn("run", F.sum((F.col("own").isNotNull() | ends).cast("int")).over(by))
    inside = Window.partitionBy("contract_id", "run").orderBy(*ORDER)
    rows = rows.withColumn("base", F.first("own").over(inside))  # a run begins with its number, or has none
    mark = F.coalesce(F.nullif(F.regexp_extract("words", LETTER, 1), F.lit("")), F.nullif(F.regexp_extract("words", LETTER, 2), F.lit("")))
    may = F.col("own").isNull() & F.col("base").isNotNull() & (F.col("role") == "lines") & (F.col("block_type") != "table")
    rows = rows.withColumn("mark", F.when(may, mark)).withColumn("roman", F.col("mark").isin(*ROMAN))
    stem, own_levels = F.regexp_extract("base", r"^([^(]*)", 1), _levels(F.col("base"))
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lists", F.sum((F.col("mark").isNotNull() & ~F.col("roman")).cast("int")).over(inside)).withColumn("last_mark", F.last("mark", ignorenulls=True).over(upto))
    above = F.when(F.col("last_mark").isNotNull(), F.concat(stem, F.lit("("), "last_mark", F.lit(")"))).when(F.size(own_levels) == 1, F.col("base"))
    under = F.coalesce("last_mark", F.when(F.size(own_levels) == 1, own_levels[0]))
    opens = F.when((F.col("mark") == "i") & (under != "h"), above)
    deep = F.when((F.size(own_levels) > 1) & (F.col("lists") == 0), tx.parent_number(F.col("base")))  # the number is itself of a roman list
    sub = Window.partitionBy("contract_id", "run", "lists").orderBy(*ORDER)
    rows = rows.withColumn("opens", opens).withColumn("open", F.coalesce(deep, F.first("opens", ignorenulls=True).over(sub.rowsBetween(Window.unboundedPreceding, 0))))
    item = F.when(F.col("mark").isNotNull(), F.concat(F.when(F.col("roman") & F.col("open").isNotNull(), F.col("open")).otherwise(stem), F.lit("("), "mark", F.lit(")")))
    rows = rows.withColumn("part", F.sum((F.col("role") == "annex").cast("int")).over(by))
    section = F.last("own", ignorenulls=True).over(Window.partitionBy("contract_id", "part").orderBy(*ORDER))
    return rows.withColumns({"number": F.coalesce("own", item), "section": section}).drop("run", "base", "mark", "roman", "lists", "last_mark", "opens", "open", "part")


def segmented(blocks: DataFrame) -> DataFrame:
    """blocks (contract_id, ord, block_id, page, block_type, text) to clauses: contract_id, chunk_id, ord, clause_id, parent_clause_id, child_clause_ids, heading, text, pages, block_ids.

    A definition or a heading without a number has the section it stands in as its parent, a number
    the nearest number above it, where that is the only one of its scope. Null texts are empty and
    give no clause where a line has to start one; an agreement without blocks gives none.
    """
    rows = listed(lines_of(blocks.withColumn("text", F.coalesce("text", F.lit("")))))
    by = Window.partitionBy("contract_id").orderBy(*ORDER)
    at = F.struct(*ORDER)
    alone = F.col("role") != "lines"
    starts = alone | F.col("number").isNotNull()
    # what is open: a start that takes what follows, or nothing after an annex
    opened = F.when(F.col("role").isin("definition", "title") | F.col("number").isNotNull(), F.struct(F.lit(True).alias("takes"), *ORDER)).when(F.col("role") == "annex", F.struct(F.lit(False).alias("takes"), *ORDER))
    rows = rows.withColumn("open", F.last(opened, ignorenulls=True).over(by))
    lead = F.struct("ord", F.lit(0).alias("line"))  # running lines of a block with nothing open before it
    rows = rows.withColumn("chunk", F.when(starts, at).when(F.coalesce(F.col("open.takes"), F.lit(False)), F.struct("open.ord", "open.line")).otherwise(lead))
    # a block's lines are one part of its clause, without white space at its ends
    parts = rows.groupBy("contract_id", "chunk", "ord").agg(
        F.min("line").alias("line"), F.first("block_id").alias("block_id"), F.first("page").alias("page"), F.min_by("role", "line").alias("role"), F.min_by("number", "line").alias("number"), F.min_by("section", "line").alias("section"),
        F.min_by("first", "line").alias("first"), F.min_by("block_type", "line").alias("block_type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "words"))), lambda x: x["words"]), "\n").alias("words"),
    )
    parts = parts.withColumn("words", F.when(F.col("role") == "lines", tx.stripped(F.col("words"))).otherwise(F.col("words"))).where((F.col("role") != "lines") | (F.col("words") != ""))
    held = F.sort_array(F.collect_list(F.struct("ord", "line", "words", "page", "block_id")))
    chunks = parts.groupBy("contract_id", "chunk").agg(
        held.alias("held"), F.min_by("role", at).alias("role"), F.min_by("number", at).alias("clause_id"), F.min_by("section", at).alias("section"), F.min_by("first", at).alias("first"), F.min_by("words", at).alias("words"), F.min_by("block_type", at).alias("block_type"),
    )
    heading = F.when(F.col("role").isin("annex", "title"), F.col("first")).when((F.col("block_type") == "heading") & F.col("clause_id").isNotNull(), F.regexp_extract("words", r"^([^\n]*)", 1))
    chunks = chunks.withColumn("heading", heading).withColumn("ord", F.row_number().over(Window.partitionBy("contract_id").orderBy("chunk")))
    scoped = context.scoped(chunks.select("*", F.array_join(F.transform("held", lambda x: x["words"]), "\n").alias("text")))
    # every number above a clause, and how many clauses of its scope have it
    wanted = F.when(F.col("clause_id").isNotNull(), tx.ancestors(F.col("clause_id"))).when(F.col("role").isin("definition", "title") & F.col("section").isNotNull(), F.array("section"))
    once = scoped.where("clause_id is not null").groupBy("contract_id", "scope", "clause_id").agg(F.count("*").alias("n")).where("n = 1").select("contract_id", "scope", F.col("clause_id").alias("above"))
    up = scoped.select("contract_id", "scope", F.col("ord").alias("child"), F.col("clause_id").alias("child_number"), F.posexplode(wanted).alias("level", "above")).join(once, ["contract_id", "scope", "above"])
    up = up.groupBy("contract_id", "scope", "child", "child_number").agg(F.min_by("above", "level").alias("parent_clause_id"))
    below = up.where("child_number is not null").groupBy("contract_id", "scope", F.col("parent_clause_id").alias("clause_id")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("child", "child_number"))), lambda x: x["child_number"])).alias("child_clause_ids"))
    out = scoped.join(up.select("contract_id", F.col("child").alias("ord"), "parent_clause_id"), ["contract_id", "ord"], "left").join(below, ["contract_id", "scope", "clause_id"], "left")
    return out.select("contract_id", F.concat(F.lit("c"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("chunk_id"), "ord", "clause_id", "parent_clause_id", "child_clause_ids", "heading", "text", F.array_distinct(F.transform("held", lambda x: x["page"].cast("int"))).alias("pages"), F.array_distinct(F.transform("held", lambda x: x["block_id"])).alias("block_ids"))
