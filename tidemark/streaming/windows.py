"""Structured Streaming forms of the window operators (STR-01..09)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


BARS = 60


def window_counts(stream: DataFrame, ts: str = "ts", late: str = "0 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """STR-01, STR-08: counts per 15-minute window; a row behind the watermark never reopens one."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return s.groupBy(F.window("_ts", "15 minutes").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def bar_alerts(stream: DataFrame, symbol: str, ts: str, close: str, volume: str, z: float = 4.0, ratio: float = 3.5, ripe: int = 15) -> DataFrame:
    """STR-06: (symbol, ts, return_z, vol_ratio, is_anomaly) with the last 60 bars of each symbol as state.

    Bars of one micro-batch are taken in the order of ts; a batch has to be after those before it.
    """
    kinds = dict(stream.dtypes)
    out = f"{symbol} {kinds[symbol]}, {ts} {kinds[ts]}, return_z double, vol_ratio double, is_anomaly boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, volumes = (list(x) for x in state.get) if state.exists else ([], [])
        rows = []
        for b in pd.concat(list(batches)).sort_values(ts).itertuples(index=False):
            bar = b._asdict()
            closes, volumes = [*closes, float(bar[close])][-BARS:], [*volumes, float(bar[volume])][-BARS:]
            if len(closes) < ripe:
                rows.append((key[0], bar[ts], 0.0, 1.0, False))
                continue
            moves = pd.Series(closes).pct_change().iloc[1:]
            early = moves.iloc[:-1]
            score = (moves.iloc[-1] - early.mean()) / (early.std(ddof=0) + 1e-8)
            busy = volumes[-1] / (sum(volumes[:-1]) / (len(volumes) - 1) + 1)
            rows.append((key[0], bar[ts], float(score), float(busy), bool(abs(score) >= z and busy >= ratio)))
        state.update((closes, volumes))
        yield pd.DataFrame(rows, columns=[symbol, ts, "return_z", "vol_ratio", "is_anomaly"])

    return stream.groupBy(symbol).applyInPandasWithState(run, out, "closes array<double>, volumes array<double>", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, key: str, ts: str, keep: str = "72 hours") -> DataFrame:
    """STR-05: each key's first row within the time it is remembered."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", keep).dropDuplicatesWithinWatermark([key]).drop("_ts")


def each_window(stream: DataFrame, steps: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """STR-02, STR-07: ordered steps over every micro-batch of what is there, resumed from the checkpoint."""

    def run(df: DataFrame, batch: int) -> None:
        df.persist()
        for s in steps:
            s(df, batch)
        df.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def same_before(run: Callable[[DataFrame], DataFrame], rows: DataFrame, changed: DataFrame, cut: int, window: str = "win") -> bool:
    """STR-03: whether outputs up to `cut` are the same for inputs that differ only after it."""
    a, b = (run(x).where(F.col(window) <= cut) for x in (rows, changed))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def revealed(df: DataFrame, clock: str, available: str = "available_at") -> DataFrame:
    """PF-12, STR-11: rows that a replay's clock has reached."""
    return df.where(F.col(available) <= F.to_timestamp(F.lit(clock)))


