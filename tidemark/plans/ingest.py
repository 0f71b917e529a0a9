"""From parsed lines to observation tables (E1-01, E1-06, AGG-02, AGG-03, SNK-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock, text
from tidemark.operators.dedup import copy_groups, first_seen
from tidemark.schemas import conforms
from tidemark.session import written
from tidemark.sources import stores


def observations(parsed: DataFrame, origin: str, lag_minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """(obs_doc, dup_links): every new object of the batches with its copy group, and the rows that repeat one."""
    rows = parsed.withColumns({"win": clock.window_of(F.col("batch_ts"), origin), "native_id": F.col("record_id")})
    rows = rows.withColumn("observation_id", text.stable_hash(F.col("record_id"), F.col("url_key"), F.col("win").cast("string")))
    rows = written(rows.dropDuplicates(["observation_id"]), "ingest-rows")
    seen = written(first_seen(rows.select("observation_id", "native_id", "url_key", F.col("win").alias("window"), "record_id")), "ingest-first-seen")
    links = seen.where("matched_on <> ''").join(rows.select("observation_id", "win"), "observation_id")
    new = rows.join(seen.where("matched_on = ''").select("observation_id"), "observation_id", "left_semi").withColumn("observed_time", F.col("batch_ts"))
    new = new.withColumns({"first_seen": clock.ingested(F.col("observed_time"), lag_minutes), "origin": F.lit("broad")})
    groups = copy_groups(new.select("observation_id", "observed_time", "title", "source_name", "url_key", "sharing_image", "authors", "all_names", "persons", "orgs", "amounts", F.lit(None).cast("array<float>").alias("vec")))
    out = new.join(groups.withColumnRenamed("evidence", "merge_evidence"), "observation_id")
    return conforms(out, "obs_doc"), conforms(links, "dup_links")


def ledger(obs: DataFrame, links: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per planned window (win, present), the windows of missing batches too."""
    own = obs.groupBy("win").agg(F.count("*").alias("new_objects"), F.count_if(F.col("copy_group") == F.col("observation_id")).alias("roots"))
    dup = links.groupBy("win").agg(F.count("*").alias("l1_dups"))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = planned.join(own, "win", "left").join(dup, "win", "left")
    return conforms(j.select("win", (~F.col("present")).alias("missing_batch"), (z("new_objects") + z("l1_dups")).alias("n_rows"), z("new_objects").alias("new_objects"), z("l1_dups").alias("l1_dups"), (z("new_objects") - z("roots")).alias("l2_merges"), z("roots").alias("roots")), "window_ledger")


def totals(window_ledger: DataFrame) -> DataFrame:
    """AGG-03: the whole run in one row."""
    return window_ledger.agg(*[F.sum(c).alias(c) for c in ("n_rows", "new_objects", "l1_dups", "l2_merges", "roots")], F.count_if("missing_batch").alias("missing_batches"))


def flush(obs: DataFrame, root: str, name: str = "obs_doc") -> None:
    stores.write_days(obs.withColumn("day", F.date_format("batch_ts", "yyyy-MM-dd")), f"{root}/{name}")
