"""Streaming extensions: decisions, deadlines, usage windows, late data and incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from policyspark.functions import truth as tr
from policyspark.sources.tables import write_stage


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """events with a time that watermarks accept."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def decisions(events: DataFrame, conditions: list[dict], state: F.Column, parameters: F.Column | None = None) -> DataFrame:
    """truth of a small policy for every event: the same column in batch and stream, without state."""
    return events.withColumn("truth", tr.compiled(conditions, state, parameters))


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Tumbling or sliding sums per party; what is later than the watermark is dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = timed(events).withWatermark("ts", late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(by, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    out = timed(events).withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, repeats within the watermark dropped."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


DEADLINE = "user_id long, opened timestamp, closed timestamp, met boolean"


def deadlines(events: DataFrame, start: str, finish: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Obligations `finish within seconds after start` per party: met when the act comes in time, missed when event time has passed it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = list(state.get[0]) if state.exists else []
        rows, limit = [], pd.Timedelta(seconds=seconds)
        seen = [(t.timestamp(), k) for b in batches for t, k in zip(b["ts"], b["event_type"], strict=True)]
        for at, kind in sorted(seen):
            if kind == finish:
                for b in [x for x in begun if x <= at]:
                    rows.append((key[0], b, at, at - b <= limit.total_seconds()))
                begun = [x for x in begun if x > at]
            if kind == start:
                begun.append(at)
        now = state.getCurrentWatermarkMs() / 1000
        for b in [x for x in begun if x + limit.total_seconds() < now]:
            rows.append((key[0], b, b + limit.total_seconds(), False))
        begun = [b for b in begun if b + limit.total_seconds() >= now]
        if begun:
            state.update((begun,))
            state.setTimeoutTimestamp(int(max(now, min(begun) + limit.total_seconds()) * 1000) + 1)
        elif state.exists:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=["user_id", "opened", "closed", "met"])
            yield out.assign(opened=pd.to_datetime(out["opened"], unit="s"), closed=pd.to_datetime(out["closed"], unit="s"))

    rows = timed(events).withWatermark("ts", late).where(F.col("event_type").isin(start, finish)).select("user_id", "ts", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, DEADLINE, "begun array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Agreements as they arrive: each micro-batch replaces the partitions of the agreements it holds, then stops when all is read."""
    return stream.writeStream.foreachBatch(lambda rows, _: write_stage(rows, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
