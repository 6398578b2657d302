"""Reading and writing stage tables, finding contracts, text and JSON blocks as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from policyspark.functions.shared import settled

BLOCKS = "contract_id string, block_id string, ord int, block_type string, text string, page int"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files; no files, no rows."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


BUCKETS = 64


def bucket() -> Column:
    return F.pmod(F.xxhash64("contract_id"), F.lit(BUCKETS)).cast("int")


def _merge(spark: SparkSession, path: str, rows: DataFrame | None, gone: DataFrame) -> None:
    """Rewrites the buckets of the agreements in gone: their rows are replaced by rows, others stay. All is made before anything is replaced."""
    parts = [r[0] for r in gone.select(bucket().alias("bucket")).distinct().collect()]
    kept = None
    try:
        kept = spark.read.parquet(path).where(F.col("bucket").isin(parts)).join(gone, "contract_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = None if rows is None else rows.withColumn("bucket", bucket())
    both = new if kept is None else kept if new is None else new.unionByName(kept.select(new.columns))
    if both is None:
        return
    held = settled(both)
    full = {r[0] for r in held.select("bucket").distinct().collect()}
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for empty in set(parts) - full:  # a bucket without rows is no part of the write
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={empty}")
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def write_stage(rows: DataFrame, path: str, stage: str | None = None) -> None:
    """A stage's rows in BUCKETS folders by agreement; the agreements at hand are replaced, each as a whole, and no others.

    Rows that break the stage's rules are counted by the job that makes them. With any, the old table
    stays as it is and ValueError names the rules.
    """
    rules, seen = RULES.get(stage or "", {}), Observation()
    if rules:
        rows = rows.observe(seen, *[F.sum((~F.coalesce(F.expr(ok), F.lit(False))).cast("long")).alias(name) for name, ok in rules.items()])
    rows = settled(rows)
    if rules and (broken := {name: n for name, n in seen.get.items() if n}):
        raise ValueError(f"{stage}: " + "; ".join(f"{n} rows break {name}" for name, n in sorted(broken.items())))
    _merge(rows.sparkSession, path, rows, settled(rows.select("contract_id").distinct()))


def drop_contracts(spark: SparkSession, path: str, contracts: DataFrame) -> None:
    """Takes the rows of some agreements out of a stage."""
    _merge(spark, path, None, settled(contracts.select("contract_id").distinct()))


def faults(rows: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """(key, problem) of rows that break a stage's rules: a name and a SQL condition each that valid rows fulfil; unknown counts as broken."""
    told = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(ok), F.lit(False)), name) for name, ok in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(told).alias("problem"))


# What rows of each stage have to fulfil.
RULES = {
    "blocks": {"block_id": r"block_id rlike '^b\\d{6}$'", "page": "page >= 1", "block_type": "block_type in ('heading', 'paragraph', 'table', 'other', 'list')", "text": "length(text) > 0"},
    "clauses": {"chunk_id": r"chunk_id rlike '^c\\d{6}$'", "ord": "ord >= 0", "text": "length(trim(text)) > 0", "pages": "size(pages) > 0", "clause_id": r"clause_id is null or clause_id rlike '^\\d{1,3}(\\.\\d{1,3})*(\\([a-z0-9]+\\))*$'"},
    "labels": {"label": "label in ('RELEVANT', 'NOT_RELEVANT', 'NEEDS_CONTEXT')"},
    "evidence": {"relationship": "target_ord is null or relationship in ('parent', 'definition', 'other', 'reference', 'retrieved')", "target": "target_ord is null or target_ord <> ord or def_text is not null"},
    "policy": {"rule_id": "rule_id like 'urn:%'", "kind": "kind in ('permission', 'prohibition', 'obligation')", "actor": "length(actor) > 0", "action": "action rlike '^[a-z][A-Za-z]*$'", "asset": "length(asset) > 0", "evidence": "length(evidence) > 0"},
}


def checked(rows: DataFrame, stage: str, key: str) -> DataFrame:
    """rows, if all of them fulfil their stage's rules; ValueError names the first that don't."""
    found = faults(rows, RULES[stage], key).orderBy("key", "problem").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.key}: {r.problem}" for r in found))
    return rows


def contracts(spark: SparkSession, root: str) -> DataFrame:
    """Names of folders under root that hold input/contract.pdf."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "contract.pdf").option("recursiveFileLookup", "true").load(root).select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)/input/contract\.pdf$", 1).alias("contract_id")).where("contract_id <> ''").orderBy("contract_id")


def pdf_blocks(spark: SparkSession, root: str, parser=None) -> DataFrame:
    """Blocks of PDF contracts by a parser: bytes to (page, block_type, text) rows; the own one for simple fonts if none is given.

    A file without any text, a locked one and one that is no PDF raise, with the contract's name.
    """
    if parser is None:
        from policyspark.sources.pdf import blocks as parser
    files = spark.read.format("binaryFile").option("pathGlobFilter", "contract.pdf").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"([^/]+)/input/contract\.pdf$", 1).alias("contract_id"), "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for key, content in zip(batch["contract_id"], batch["content"], strict=True):
                try:
                    rows = [(key, f"b{i:06d}", i, kind, text, page) for i, (page, kind, text) in enumerate(parser(content), 1)]
                except ValueError as e:
                    raise ValueError(f"{key}: {e}") from e
                if not any(r[4].strip() for r in rows):
                    raise ValueError(f"{key}: no text")
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.mapInPandas(run, BLOCKS)


class ContractBlocks(DataSource):
    """format("contract_blocks"): plain text files, a block a paragraph, 40 lines a page. Option path: a folder or file."""

    @classmethod
    def name(cls) -> str:
        return "contract_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _where(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, path = self._where()
        if where.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(path)]
        found = where.get_file_info(fs.FileSelector(path))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".txt")]

    def read(self, partition: InputPartition):
        line, n = 0, 0
        with self._where()[0].open_input_stream(partition.value) as f:
            text = f.read().decode("utf-8")
        for part in text.split("\n\n"):
            if part.strip():
                n += 1
                kind = "heading" if len(part) < 80 and part.isupper() else "paragraph"
                yield (partition.value.rpartition("/")[2].removesuffix(".txt"), f"b{n:06d}", n, kind, part.strip("\n"), 1 + line // 40)
            line += part.count("\n") + 2
