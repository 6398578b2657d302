"""What the training-data operators share: tables, checkpoints, folds, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT, FEW, SALTS = 10_000, 1_000_000, 64  # shares that make a key hot; rows of ids a broadcast may have; parts of a hot key

GAP, SLICE = re.compile(rb"[ \t-\r]"), 1 << 20  # white space; bytes split at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which the context then writes checkpoints to as well.

    Unset, one of our own is made where driver and executors are one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="policyspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def unused(columns: list[str], name: str) -> str:
    """name, made longer until no column has it whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(column: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 and so on: functions over batches take columns by name, and dots and quotes are no part of one there."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def typed(df: DataFrame, *columns: str, **more: T.DataType) -> T.StructType:
    """The schema of some columns of df, as they are, with more columns after them."""
    return T.StructType([df.schema[c] for c in columns] + [T.StructField(n, t) for n, t in more.items()])


def known_few(ids: DataFrame) -> DataFrame:
    """ids of one or two long columns, to be broadcast where a count proves them to be few; else as they are, for a shuffle."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def hot_keys(counts: DataFrame, total: int) -> DataFrame:
    """The keys of counts(keys, n) that have more than a HOT-th of `total` rows each. They can only be HOT at most."""
    return checkpoint(counts.where(F.col("n") * HOT > total).drop("n"))


def lookup(rows: DataFrame, side: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with side, which has a row a key at most; keys of `hot` are joined where their rows are.

    A HOT-th of the rows is the most that one key can then bring into a task. how: inner or left.
    """
    hot = F.broadcast(hot)
    few = rows.join(hot, on, "left_semi").join(F.broadcast(side.join(hot, on, "left_semi")), on, how)
    return rows.join(hot, on, "left_anti").join(side, on, how).unionByName(few)


def meet(rows: DataFrame, side: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of rows with the smaller side; rows of keys of `hot` are dealt into SALTS parts, the side's repeated for each."""
    hot = F.broadcast(hot)
    salted = rows.join(hot, on, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*(c for c in rows.columns)), F.lit(SALTS)))
    each = side.join(hot, on, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(hot, on, "left_anti").join(side, on).unionByName(salted.join(each, [*on, "_salt"]).drop("_salt"))


def fold(id_column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def bounded_sample(df: DataFrame, key: str, groups: list[str], per_group: int) -> DataFrame:
    """At most per_group rows of each combination of groups, the same ones at every run.

    The hash of the key deals the rows of a group into per_group slots and the smallest hash
    of a slot stays: two partial aggregations over (group, key), no sort, no large group.
    Rows whose key is null are never chosen.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    slots = df.where(F.col(key).isNotNull()).select(*groups, key, F.pmod(h, F.lit(per_group)).alias("_slot"), F.xxhash64(h, F.lit(7)).alias("_h"))
    chosen = slots.groupBy(*groups, "_slot").agg(F.min_by(key, "_h").alias(key))
    return chosen.select(key).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the least node of its component.

    Alternating large-star and small-star rounds over edges from the greater node to the lesser;
    each round is two partial aggregations with their lookups and ends in a checkpoint, so nothing
    but numbers reach the driver. Nodes of very many edges, as roots of large components are, are
    looked up where their edges lie. A table without edges gives no rows.
    """
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, total = None, now.count()

    def least(pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
        """The least lesser neighbour of each greater node, and the keys that lookups of pairs by `key` find hot."""
        hot = hot_keys(pairs.groupBy(key).agg(F.count("*").alias("n")), total) if total > FEW else None
        return pairs.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("m")), hot

    def look(pairs: DataFrame, key: str, how: str) -> DataFrame:
        side, hot = least(pairs, key)
        return pairs.join(side, key, how) if hot is None else lookup(pairs, side, [key], hot, how)

    for _ in range(max_rounds):
        large = checkpoint(look(now, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        joined = look(large, "u", "inner")
        star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(star.unionByName(joined.select("u", F.col("m").alias("v"))).distinct())
        total, code = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (total, code) == mark:
            break
        mark = (total, code)
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def give_back() -> None:
    """Memory that is free in this process goes back to the system; Python workers live on from task to task, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words(dict[bytes, int]):
    """Numbers of words, given at their first lookup; `names` has the words by number."""

    def __init__(self, first: Iterable[bytes] = ()) -> None:
        self.names: list[bytes] = []
        for word in first:
            self[word]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """The text's words as numbers. A long text is split in slices that end at a gap."""
        parts, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (gap := GAP.search(text, at + SLICE)):
                end = gap.start()
            words = text[at:end].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            at = end + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
