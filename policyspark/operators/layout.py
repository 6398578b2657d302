"""Layout of pages: spans with places and sizes become typed, numbered blocks in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policyspark.functions.text import clause_number

HEIGHT = 842.0
# Margins of a page, dot leaders of a table of contents, page numbers.
TOP, BOTTOM, FOOTNOTE = 0.075, 0.87, 0.72
LEADERS = r"\.{4,}\s*\d+\s*$"
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as spans: doc_id, pos, page, x0, y0, size, bold_chars, min_size, text; all places follow from the line's number.

    The first lines of every fourth document end in dot leaders, as a table of contents does.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    pos, size = F.col("pos"), 8 + F.length("line") % 5
    text = F.when((F.col("doc_id") % 4 == 0) & (pos < 5), F.concat("line", F.lit(" ..... "), pos.cast("string"))).otherwise(F.col("line"))
    n = F.length("text")
    bold = F.when(pos % 7 == 0, n).when(pos % 7 == 1, F.floor(n / 2)).when(pos % 7 == 2, F.floor(n * 7 / 10) + 1).otherwise(0).cast("int")
    rows = docs.select("doc_id", "pos", (1 + F.floor(pos / 40)).cast("int").alias("page"), (72.0 + (pos % 3) * 10).alias("x0"), (10.0 + (pos % 40) * 20.5).alias("y0"), size.alias("size"), F.when(pos % 5 == 3, size - 2).otherwise(size).alias("min_size"), text.alias("text"))
    return rows.withColumn("bold_chars", bold)


def body_sizes(rows: DataFrame, default: float = 12) -> DataFrame:
    """The size most characters of a page have; ties to the size that comes first on it."""
    sizes = rows.groupBy("doc_id", "page", "size").agg(F.sum(F.length(F.trim("text"))).alias("n"), F.min("pos").alias("first"))
    return sizes.groupBy("doc_id", "page").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body_size")).withColumn("body_size", F.coalesce("body_size", F.lit(default)))


def reading_order(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("y0") / 3), "x0", "pos")
    return rows.withColumn("reading_order", F.row_number().over(w))


def typed(rows: DataFrame) -> DataFrame:
    """block_type heading, paragraph or other, by size, weight, margins, page numbers and footnotes."""
    body = body_sizes(rows)
    t = rows.join(body, ["doc_id", "page"])
    heading = (F.length("text") < 250) & ((F.col("bold_chars") > 0.65 * F.length("text")) | (F.col("min_size") > 1.15 * F.col("body_size")))
    margin = (F.col("y0") < TOP * HEIGHT) | (F.col("y0") > BOTTOM * HEIGHT)
    other = (margin & F.col("text").rlike(PAGE_NUMBER)) | ((F.col("y0") > BOTTOM * HEIGHT) & (F.col("size") < FOOTNOTE * F.col("body_size")))
    return t.withColumn("marginal", margin).withColumn("block_type", F.when(other, "other").when(heading, "heading").otherwise("paragraph"))


def contents_pages(rows: DataFrame, least: int = 3, leaders: str = LEADERS) -> DataFrame:
    """Pages with at least `least` lines of dot leaders."""
    return rows.groupBy("doc_id", "page").agg(F.sum(F.col("text").rlike(leaders).cast("long")).alias("leaders")).where(F.col("leaders") >= least)


def running_lines(rows: DataFrame, least: int = 3) -> DataFrame:
    """Marginal lines, digits masked, that stand on at least `least` pages of a document."""
    key = F.regexp_replace(F.trim("text"), r"\d", "#")
    return rows.withColumn("line_key", key).groupBy("doc_id", "line_key").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks with document-wide ids in reading order; contents pages and running lines become `other` and lose their number."""
    t = typed(rows)
    toc = contents_pages(rows).select("doc_id", "page", F.lit(True).alias("toc"))
    running = running_lines(t.where("marginal")).select("doc_id", "line_key", F.lit(True).alias("running"))
    t = t.join(toc, ["doc_id", "page"], "left").withColumn("line_key", F.regexp_replace(F.trim("text"), r"\d", "#")).join(running, ["doc_id", "line_key"], "left")
    kind = F.when(F.coalesce("toc", F.lit(False)) | (F.coalesce("running", F.lit(False)) & F.col("marginal")), "other").otherwise(F.col("block_type"))
    w = Window.partitionBy("doc_id").orderBy("page", F.bround(F.col("y0") / 3), "x0", "pos")
    return t.withColumn("block_type", kind).withColumn("ord", F.row_number().over(w)).select(
        "doc_id", F.concat(F.lit("b"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("block_id"), "ord", "page", "block_type",
        F.when(F.col("block_type") != "other", clause_number(F.col("text"))).alias("numbering"), "text",
    )


def table_members(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans whose middle lies in a table of at least two rows and columns of their page, or in its header's box; the first table wins.

    Spans may have x1 and y1, else they are taken for 100 by 10 points; tables may have a header box
    hx0, hx1, hy0, hy1. An equi-join on the page with the range as its residue, so no product of
    pages and tables.
    """
    big = tables.where("table_rows >= 2 and table_columns >= 2")
    x = (F.col("x0") + F.col("x1")) / 2 if "x1" in rows.columns else F.col("x0") + 50
    y = (F.col("y0") + F.col("y1")) / 2 if "y1" in rows.columns else F.col("y0") + 5
    inside = x.between(F.col("tx0"), F.col("tx1")) & y.between(F.col("ty0"), F.col("ty1"))
    if "hx0" in tables.columns:
        inside = inside | F.coalesce(x.between(F.col("hx0"), F.col("hx1")) & y.between(F.col("hy0"), F.col("hy1")), F.lit(False))
    hits = rows.join(big, ["doc_id", "page"]).where(inside)
    return hits.groupBy("doc_id", "pos", "page", "y0").agg(F.min("table_no").alias("table_no"))


def table_rows(members: DataFrame, bands: DataFrame) -> DataFrame:
    """The row whose band holds a member within two points, if it is the only one; else null."""
    hits = members.join(bands, ["doc_id", "page", "table_no"], "left").where(F.col("band").isNull() | ((F.col("y0") >= F.col("by0") - 2) & (F.col("y0") + 10 <= F.col("by1") + 2)))
    found = hits.groupBy("doc_id", "pos", "table_no").agg(F.when(F.count("band") == 1, F.max("band")).alias("table_row"))
    return members.select("doc_id", "pos", "table_no").join(found, ["doc_id", "pos", "table_no"], "left")


def visual_rows(members: DataFrame) -> DataFrame:
    """Rows by base line: a span more than three points below the first of its row opens the next. A table's spans are one sorted array, folded once."""
    spans_ = members.groupBy("doc_id", "page", "table_no").agg(F.sort_array(F.collect_list(F.struct("y0", "pos"))).alias("spans"))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("start"), F.array().cast("array<struct<pos:int,visual_row:int>>").alias("out"))

    def step(acc, x):
        new = acc["start"].isNull() | (x["y0"] - acc["start"] > 3)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when(new, x["y0"]).otherwise(acc["start"]).alias("start"), F.concat(acc["out"], F.array(F.struct(x["pos"].cast("int").alias("pos"), row.alias("visual_row")))).alias("out"))

    folded = F.aggregate("spans", zero, step, lambda acc: acc["out"])
    return spans_.select("doc_id", "table_no", F.explode(folded).alias("s")).select("doc_id", "s.pos", "table_no", "s.visual_row")
