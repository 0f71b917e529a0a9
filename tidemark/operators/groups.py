"""Python over groups of rows that stream through a task, many groups to a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def by_group(df: DataFrame, key: str, run: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """run's rows for each group of equal keys, null being one of them. A task holds a batch of rows and the group that it ends with, and Spark is called once for a batch, not once for a group."""
    names = StructType.fromDDL(schema).fieldNames()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if held and not _same(held[-1][key].iloc[-1], b[key].iloc[0]):
                yield pd.DataFrame(run(pd.concat(held, ignore_index=True)), columns=names)
                held = []
            k = b[key]
            new = np.flatnonzero(((k != k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()[1:]) + 1
            if len(new):
                cuts = [0, *new.tolist()]
                rows = []
                for s, e in zip(cuts, cuts[1:], strict=False):
                    own = b.iloc[s:e]
                    rows += run(pd.concat([*held, own], ignore_index=True) if held else own)
                    held = []
                yield pd.DataFrame(rows, columns=names)
                held = [b.iloc[cuts[-1] :]]
            else:
                held.append(b)
        if held:
            yield pd.DataFrame(run(pd.concat(held, ignore_index=True)), columns=names)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(stream, schema)


def folded(df: DataFrame, key: str, order: list[str], start: Callable[[], Callable[[dict], tuple]], schema: str) -> DataFrame:
    """One row for each row of df, from a state that sees its group's rows in order. Only the state is held, however large the group."""
    names = StructType.fromDDL(schema).fieldNames()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, push = None, None
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                if push is None or not _same(r[key], now):
                    now, push = r[key], start()
                rows.append(push(r))
            yield pd.DataFrame(rows, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(stream, schema)


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))
