"""Price series: returns, market model, abnormal moves, clusters, session bars (OBS, AGG-12..15, AGG-20, WIN-02..08)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, stats
from tidemark.operators.components import connected_components


@dataclass(frozen=True)
class Limits:
    """When a move is abnormal, and over which rows before it that is judged."""

    sar: float = 4.0
    mz: float = 5.0
    mv: float = 3.5
    mg: float = 5.0
    corr: float = 0.4
    first: int = 260
    last: int = 11
    volume: int = 60
    shared_days: int = 60


def adjusted(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """prices with `adj`: closes less the dividends still to come, as factors; a null dividend is none (OBS-05, WIN-08, JOIN-18)."""
    paid = actions.where("kind = 'dividend'").groupBy("symbol", "date").agg(F.sum("value").alias("paid"))
    w = W.partitionBy("symbol").orderBy("date")
    p = prices.join(paid, ["symbol", "date"], "left").withColumn("before", F.lag("close").over(w))
    p = p.withColumn("f", F.when(F.col("paid").isNotNull() & (F.col("before") > 0) & (F.col("paid") < F.col("before")), F.log(1 - F.col("paid") / F.col("before"))).otherwise(0.0))
    return p.withColumn("adj", F.col("close") * F.exp(F.coalesce(F.sum("f").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0)))).drop("paid", "before", "f")


def returns(series: DataFrame, close: str = "close") -> DataFrame:
    """(symbol, day, r): change against the row before; null for a symbol's first and after a zero."""
    return series.select("symbol", "day", (F.try_divide(F.col(close), F.lag(close).over(W.partitionBy("symbol").orderBy("day"))) - 1).alias("r"))


def market_model(own: DataFrame, market: DataFrame, limits: Limits = Limits(), least: int = 200) -> DataFrame:
    """Per symbol and day, least squares of returns on the market's over earlier common days: alpha, beta, ar, sar, n.

    Days with fewer than `least` pairs of returns in their frame have no row.
    """
    j = own.join(market.select("day", F.col("r").alias("m")), "day")
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(-limits.first, -limits.last)
    on = lambda f: f("r", "m").over(w)
    f = j.select("symbol", "day", "r", "m", on(F.regr_slope).alias("beta"), on(F.regr_intercept).alias("alpha"), on(F.regr_count).alias("n"), on(F.regr_sxx).alias("sxx"), on(F.regr_syy).alias("syy"), on(F.regr_sxy).alias("sxy"), on(F.regr_avgx).alias("mx"))
    f = f.where(F.col("n") >= least).withColumn("ar", F.col("r") - F.col("alpha") - F.col("beta") * F.col("m"))
    s2 = (F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))) / (F.col("n") - 2)
    off = F.col("m") - F.col("mx")
    return f.select("symbol", "day", "n", "alpha", "beta", "r", "m", "ar", F.try_divide(F.col("ar"), F.sqrt(s2 * (1 + 1 / F.col("n") + F.try_divide(off * off, F.col("sxx"))))).alias("sar"))


def residual_correlations(ar: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(a, b, n, corr) of every two symbols over shared days; 0 under the least number of them. For the few series that fired, not for all."""
    x, y = ar.select(F.col("symbol").alias("a"), "day", F.col("ar").alias("x")), ar.select(F.col("symbol").alias("b"), "day", F.col("ar").alias("y"))
    p = x.join(y, "day").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n"))
    return p.select("a", "b", "n", F.when(F.col("n") < limits.shared_days, 0.0).otherwise(F.col("c")).alias("corr"))


def daily_statistics(prices: DataFrame, market: str, limits: Limits = Limits()) -> DataFrame:
    """OBS-01: one row per symbol and day with R, gap, AR, SAR, Mz, Mv, Mg, fired. prices: symbol, day, open, close, volume."""
    own = W.partitionBy("symbol").orderBy("day")
    p = prices.select("symbol", "day", "volume", (F.try_divide(F.col("open"), F.lag("close").over(own)) - 1).alias("gap"), (F.try_divide(F.col("close"), F.lag("close").over(own)) - 1).alias("r"))
    p = p.withColumn("lv", F.log(F.greatest(F.col("volume"), F.lit(1)).cast("double"))).withColumn("volumes", F.collect_list("lv").over(own.rowsBetween(-limits.volume, -1)))
    m = p.where(F.col("symbol") == market).select("day", F.col("r").alias("m"))
    j = p.where(F.col("symbol") != market).join(m, "day")
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(-limits.first, -limits.last)
    fit = market_model(j.select("symbol", "day", "r"), m.withColumnRenamed("m", "r"), limits).select("symbol", "day", "alpha", "beta", "ar", "sar")
    frames = j.select("symbol", "day", "r", "gap", "lv", "volumes", F.collect_list(F.struct("r", "m")).over(w).alias("pairs"), F.collect_list("gap").over(w).alias("gaps"), F.count("*").over(W.partitionBy("symbol").orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("days"))
    s = frames.join(fit, ["symbol", "day"]).where(F.col("days") >= limits.first + 2)
    residuals = F.filter(F.transform("pairs", lambda x: x["r"] - F.col("alpha") - F.col("beta") * x["m"]), lambda x: x.isNotNull())
    s = s.select("symbol", "day", "r", "gap", "alpha", "beta", "ar", "sar", stats.robust_z(F.col("ar"), residuals).alias("mz"), stats.robust_z(F.col("lv"), F.col("volumes")).alias("mv"), stats.robust_z(F.col("gap"), F.col("gaps")).alias("mg"))
    moved = (F.abs("sar") >= limits.sar) | (F.abs("mz") >= limits.mz)
    return s.withColumn("fired", moved & ((F.col("mv") >= limits.mv) | (F.abs("mg") >= limits.mg)))


def secondary(statistics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """PF-08: gaps without a full trigger."""
    return statistics.where(~F.col("fired") & (F.abs("mg") >= limits.mg))


def estimation_residuals(prices: DataFrame, fired: DataFrame, market: str, limits: Limits = Limits()) -> DataFrame:
    """(symbol, day, ar) over the estimation days before one day's fired symbols, by the model that was fitted on them."""
    r = returns(prices)
    m = r.where(F.col("symbol") == market).select("day", F.col("r").alias("m"))
    at = fired.select("symbol", F.col("day").alias("at"), "alpha", "beta")
    j = r.join(at, "symbol").where(F.col("day") <= F.col("at")).join(m, "day")
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("day"))) - 1
    return j.withColumn("back", back).where(F.col("back").between(limits.last, limits.first)).select("symbol", "day", (F.col("r") - F.col("alpha") - F.col("beta") * F.col("m")).alias("ar")).where("ar IS NOT NULL")


def fired_clusters(fired: DataFrame, residuals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """OBS-02: (symbol, cluster) of one day's fired symbols, joined where moves have one sign and residuals correlate."""
    c = residual_correlations(residuals.join(fired.select("symbol"), "symbol", "left_semi"), limits).where(F.col("corr") >= limits.corr)
    sign = fired.select("symbol", F.signum("ar").alias("sign"))
    links = c.join(sign.select(F.col("symbol").alias("a"), F.col("sign").alias("sa")), "a").join(sign.select(F.col("symbol").alias("b"), F.col("sign").alias("sb")), "b").where("sa = sb")
    found = connected_components(links.select("a", "b")).withColumnRenamed("node", "symbol")
    return fired.select("symbol").join(found, "symbol", "left").select("symbol", F.coalesce("component", "symbol").alias("cluster"))


def cutoff(fired: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """OBS-03: per day the earliest session start at which a fired symbol's move could show."""
    venue = F.when(F.col("symbol").endswith(".AS"), "AS").otherwise("US")
    return fired.groupBy("day").agg(F.min(clock.session_open_utc(F.to_date("day"), venue, F.abs("mg") >= limits.mg)).alias("tau"))


def bar_alerts(bars: DataFrame, symbol: str, order: list[str], close: str, volume: str, bars_kept: int = 60, ripe: int = 15, z: float = 4.0, ratio: float = 3.5) -> DataFrame:
    """STR-06 in batch: a bar's return and volume against the others of the last bars_kept; 0 and 1 before `ripe` of them."""
    w = W.partitionBy(symbol).orderBy(*order)
    b = bars.withColumn("_r", F.try_divide(F.col(close), F.lag(close).over(w)) - 1)  # null after a zero
    # a frame of n bars has n - 1 returns, the last of which is judged
    early = w.rowsBetween(-(bars_kept - 2), -1)
    b = b.select("*", F.count("*").over(w.rowsBetween(-(bars_kept - 1), 0)).alias("_n"), F.avg("_r").over(early).alias("_m"), F.stddev_pop("_r").over(early).alias("_s"), F.avg(volume).over(w.rowsBetween(-(bars_kept - 1), -1)).alias("_v"))
    few = F.col("_n") < ripe
    out = b.withColumn("return_z", F.when(few, 0.0).otherwise((F.col("_r") - F.col("_m")) / (F.col("_s") + 1e-8))).withColumn("vol_ratio", F.when(few, 1.0).otherwise(F.col(volume) / (F.col("_v") + 1)))
    return out.withColumn("is_anomaly", (F.abs("return_z") >= z) & (F.col("vol_ratio") >= ratio)).drop("_r", "_n", "_m", "_s", "_v")


def session_bars(trades: DataFrame, session: str) -> DataFrame:
    """AGG-20: trades have `at` (an order), price and volume."""
    return trades.groupBy(session).agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"), F.stddev_pop("price").alias("sd"))


def change_since(prices: DataFrame, reference: Column) -> DataFrame:
    """WIN-11: change from the last close before a day."""
    return prices.groupBy("symbol").agg((F.try_divide(F.max_by("close", "day"), F.max_by(F.when(F.col("day") < reference, F.col("close")), F.when(F.col("day") < reference, F.col("day")))) - 1).alias("change"))


def quiet_days(statistics: DataFrame, below: float = 1.0) -> DataFrame:
    """OBS-06: days on which no symbol fired and every standardised move is small."""
    return statistics.groupBy("day").agg(F.bool_or("fired").alias("any"), F.max(F.abs("sar")).alias("most")).where(~F.col("any") & (F.col("most") < below)).select("day")
