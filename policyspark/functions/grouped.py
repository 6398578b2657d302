"""Sequential work on sorted groups, many groups to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_groups(rows: DataFrame, key: str, order: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function over the rows of each key, in order. Groups stream through a task in key order, so one costs no more than its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[key].iloc[-1]
            if kept and kept[0][key].iloc[0] == last:
                kept.append(batch)  # a group of many batches is put together once, at its end
                continue
            batch = pd.concat([*kept, batch], ignore_index=True)
            whole, kept = batch[batch[key] != last], [batch[batch[key] == last]]
            out = [function(g) for _, g in whole.groupby(key, sort=False)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if kept:
            yield function(pd.concat(kept, ignore_index=True))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
