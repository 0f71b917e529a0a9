"""A day's case: terminals, cost graph, explanations, placebos, hypotheses (E3A-01..08, E3B-01..02, OBS-04)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, stats, text
from tidemark.operators import search
from tidemark.operators.observer import Limits, cutoff, daily_statistics, estimation_residuals, fired_clusters

FLOOR, BASE, TILT, LINKS = 0.01, 0.05, 0.5, 25
DECAY_WINDOWS, ALPHA_DAYS, OBJECT_DAYS = 3 * clock.PER_DAY, 30, 14


def build_case(prices: DataFrame, day: str, market: str, funds: set[str], limits: Limits = Limits()) -> dict:
    """OBS-04: the day's statistics and clusters, as a small document. A day without a fired symbol has no cutoff."""
    s = daily_statistics(prices, market, limits).where(F.col("day") == day).cache()
    fired = s.where("fired")
    rows = [r.asDict() for r in s.orderBy("symbol").collect()]  # one row per symbol of one day
    groups: dict[str, list[str]] = {}
    if any(r["fired"] for r in rows):
        for r in fired_clusters(fired, estimation_residuals(prices, fired, market, limits), limits).collect():
            groups.setdefault(r.cluster, []).append(r.symbol)
    clusters = sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g))
    tau = cutoff(fired, limits).first()
    s.unpersist()
    return {"day": day, "stats": [{"symbol": r["symbol"], "R": r["r"], "gap": r["gap"], "AR": r["ar"], "SAR": r["sar"], "Mz": r["mz"], "Mv": r["mv"], "Mg": r["mg"], "fired": r["fired"]} for r in rows], "clusters": clusters, "terminal_clusters": [g for g in clusters if not funds.issuperset(g)], "tau_star": tau.tau.isoformat() if tau else None}


def terminal_patterns(clusters: list[list[str]], names: dict[str, list[str]], subjects: dict[str, list[str]]) -> list[str]:
    """E3A-02, SCA-25: a pattern over normalised text per cluster; names stand between spaces, subjects begin a word."""
    out = []
    for g in clusters:
        whole = [f" {a} " for s in g for a in text.aliases(names.get(s, []), s)]
        out.append("|".join(sorted({*whole, *(f" {p}" for s in g for p in text.lexicon(subjects.get(s, [])))})))
    return out


def _weight(t: Column, now: int) -> Column:
    return F.exp(-(now - t) / F.lit(float(DECAY_WINDOWS)))


def parent_probabilities(alpha: DataFrame, series: DataFrame, now: int) -> DataFrame:
    """E3A-03: (source, target, p, sigma): decayed shares of each target's parents, renormalised, tilted by how unusual their last day is, kept from FLOOR on.

    alpha: target, source, win, alpha; series: narrative_id, win, y. Only windows up to now count.
    """
    since = now - ALPHA_DAYS * clock.PER_DAY
    a = alpha.where(F.col("win").between(since + 1, now))
    y = series.where(F.col("win").between(since + 1, now)).select(F.col("narrative_id").alias("target"), "win", "y", (_weight(F.col("win"), now) * F.col("y")).alias("wy"))
    den = y.groupBy("target").agg(F.sum("wy").alias("den"))
    num = a.join(y, ["target", "win"], "left").groupBy("source", "target").agg(F.sum(F.coalesce("wy", F.lit(0.0)) * F.col("alpha")).alias("num"))
    day, today = F.floor(F.col("win") / clock.PER_DAY), now // clock.PER_DAY
    daily = a.where("source <> 'BOT'").groupBy("source", "target", day.alias("day")).agg(F.avg("alpha").alias("x"))
    surprise = daily.groupBy("source", "target").agg(F.max(F.when(F.col("day") == today, F.col("x"))).alias("x"), F.collect_list(F.when(F.col("day") < today, F.col("x"))).alias("ref"))
    surprise = surprise.select("source", "target", F.when(F.col("x").isNotNull(), stats.robust_z(F.col("x"), F.col("ref"), least=5)).otherwise(0.0).alias("sigma"))
    p = num.join(den, "target").where("den > 0").withColumn("p", F.col("num") / F.col("den")).join(surprise, ["source", "target"], "left").withColumn("sigma", F.coalesce("sigma", F.lit(0.0)))
    by = W.partitionBy("target")
    p = p.withColumn("p", F.col("p") / F.sum("p").over(by) * F.exp(TILT * F.greatest("sigma", F.lit(0.0))))
    return p.withColumn("p", F.col("p") / F.sum("p").over(by)).where(F.col("p") >= FLOOR).select("source", "target", "p", "sigma")


def terminal_links(objects: DataFrame, series: DataFrame, patterns: list[str], now: int) -> DataFrame:
    """AGG-11, AGG-12, WIN-09: (source, target, p): narratives whose objects name a terminal more than others do, by a softmax over at most LINKS of them.

    objects: win, text (normalised), narrative_id, share; patterns[i] is terminal Ti's.
    """
    o = objects.where(F.col("win").between(now - OBJECT_DAYS * clock.PER_DAY + 1, now)).withColumn("w", _weight(F.col("win"), now) * F.col("share"))
    o = o.select("narrative_id", "w", F.posexplode(F.array(*[F.col("text").rlike(p) for p in patterns])).alias("t", "hit"))
    g = o.groupBy("t", "narrative_id").agg(F.sum("w").alias("u"), F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("ux"))
    all_ = g.groupBy("t").agg(F.sum("u").alias("a"), F.sum("ux").alias("ax"))
    day = F.floor((F.col("win") - (now + 1)) / clock.PER_DAY).cast("int") + 30  # 29 is the last whole day
    d = series.where(F.col("win").between(now - 30 * clock.PER_DAY + 1, now)).groupBy("narrative_id", day.alias("d")).agg(F.sum("y").alias("y")).groupBy("narrative_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "y"))).alias("m"))
    at = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
    z = d.select("narrative_id", stats.robust_z(at(F.lit(29)), F.transform(F.sequence(F.lit(0), F.lit(28)), at), least=5).alias("z"))
    s = g.join(all_, "t").where("ux > 0 AND u > 0").join(z, "narrative_id", "left")
    s = s.select("t", "narrative_id", (F.log((F.col("ux") / F.col("u")) / (F.col("ax") / F.col("a")) + 1e-3) + F.coalesce("z", F.lit(0.0))).alias("score"))
    s = s.withColumn("n", F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "narrative_id"))).where(F.col("n") <= LINKS)
    e = F.exp(F.col("score") - F.max("score").over(W.partitionBy("t")))
    s = s.withColumn("e", e).withColumn("p", (1 - BASE) * F.col("e") / F.sum("e").over(W.partitionBy("t"))).where(F.col("p") >= FLOOR)
    return s.select(F.col("narrative_id").alias("source"), F.concat(F.lit("T"), "t").alias("target"), "p")


def cost_graph(parents: DataFrame, links: DataFrame, n_terminals: int) -> DataFrame:
    """(u, v, cost) of the whole graph; every terminal may also be left unexplained, straight from BOT."""
    spark = parents.sparkSession
    base = spark.createDataFrame([("BOT", f"T{i}", BASE) for i in range(n_terminals)], "source string, target string, p double")
    every = parents.select("source", "target", "p").unionByName(links).unionByName(base)
    return every.select(F.col("source").alias("u"), F.col("target").alias("v"), stats.edge_cost(F.col("p")).alias("cost"))


def explain(alpha: DataFrame, series: DataFrame, objects: DataFrame, patterns: list[str], cutoffs: dict[str, int]) -> DataFrame:
    """E3A-07, E3A-08: the real case and its placebos side by side: (case, part, cost, abstain_cost, tree, rivals), one graph per cutoff window."""
    out = None
    for name, now in sorted(cutoffs.items()):
        g = cost_graph(parent_probabilities(alpha, series, now), terminal_links(objects, series, patterns, now), len(patterns)).withColumn("case", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return search.explain_graphs(out, "case", terminals=[f"T{i}" for i in range(len(patterns))])


def placebo_report(explained: DataFrame, real: str) -> DataFrame:
    """AGG-16: (k, p, fer): where the real cost lies among placebos' and how many of them were explained at all."""
    c = explained.groupBy("case").agg(F.sum("cost").alias("cost"), F.bool_or(F.col("cost") < F.col("abstain_cost")).alias("explained"))
    its = c.where(F.col("case") == real).agg(F.max("cost")).scalar()
    j = c.where(F.col("case") != real).withColumn("low", F.col("cost") <= its)
    return j.agg(F.count("*").alias("k"), ((1 + F.count_if("low")) / (1 + F.count("*"))).alias("p"), F.avg(F.col("explained").cast("int")).alias("fer"))


def placebo_cutoffs(days: list[str], seed: int, n: int = 20) -> list[tuple[str, int]]:
    """OBS-06, SRT-06: n quiet days and a window of 08:00 to 20:45 on each, sorted, the same for a seed."""
    import numpy as np

    rng = np.random.Generator(np.random.Philox(key=seed))
    chosen = sorted(rng.choice(len(days), size=min(n, len(days)), replace=False).tolist())
    return [(days[i], int(rng.integers(32, 84))) for i in chosen]


def hypotheses(trees: DataFrame, memberships: DataFrame, series: DataFrame, now: int) -> DataFrame:
    """E3B-01, AGG-05, AGG-06: per entry narrative of an explanation, its largest event cluster and whether it burst in the day before the cutoff.

    trees: case, narrative_id, sigma_least (the least surprise along its narrative edges, null without any).
    """
    span = F.col("win").between(now - clock.PER_DAY + 1, now)
    e = memberships.where(span & (F.col("p1") > 0)).groupBy(F.col("n1").alias("narrative_id"), "event_cluster").agg(F.count("*").alias("c"))
    e = e.withColumn("n", F.row_number().over(W.partitionBy("narrative_id").orderBy(F.desc("c"), "event_cluster"))).where("n = 1").select("narrative_id", "event_cluster")
    b = series.where(span).groupBy("narrative_id").agg(F.bool_or("burst").alias("burst"))
    j = trees.join(e, "narrative_id", "left").join(b, "narrative_id", "left")
    return j.select("case", "narrative_id", "event_cluster", (F.coalesce("burst", F.lit(False)) & F.coalesce(F.col("sigma_least") > 0, F.lit(True))).alias("signature"))


def event_reports(clusters: DataFrame, memberships: DataFrame, docs: DataFrame, limit: int = 60) -> DataFrame:
    """JOIN-01, SRT-02: each cluster's first documents, in the order they were seen. The limit is the report's length."""
    m = memberships.join(clusters.select("event_cluster").distinct(), "event_cluster", "left_semi").select("observation_id", "event_cluster")
    d = m.join(docs, "observation_id")
    return d.withColumn("place", F.row_number().over(W.partitionBy("event_cluster").orderBy("first_seen", "observation_id"))).where(F.col("place") <= limit)


def subject_of(names: Column) -> Column:
    """AGG-07: the most frequent lower-cased name of an array of arrays, the smallest in a tie; null if there is none."""
    low = F.transform(F.flatten(names), lambda x: F.lower(x))
    counted = F.transform(F.array_distinct(low), lambda x: F.struct((-F.size(F.filter(low, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.get(F.array_sort(counted), F.lit(0)).getField("x")


def odds(cost: float, rival: float) -> float:
    return math.exp((rival - cost) / 1000)
