"""Table contracts: DDL of every table, and checks of their invariants (section 1 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "obs_doc": "observation_id string, record_id string, native_id string, win long, batch_ts timestamp, observed_time timestamp, first_seen timestamp, origin string, source_name string, url string, url_key string, title string, published_time timestamp, authors array<string>, themes array<string>, countries array<string>, persons array<string>, orgs array<string>, all_names array<string>, tone float, word_count int, sharing_image string, quotations array<struct<verb: string, quote: string>>, amounts array<struct<amount: double, object: string>>, copy_group string, merge_evidence string",
    "dup_links": "observation_id string, canonical_id string, matched_on string, win long",
    "window_ledger": "win long, missing_batch boolean, n_rows long, new_objects long, l1_dups long, l2_merges long, roots long",
    "e2a_memberships": "observation_id string, win long, is_root boolean, event_cluster long, n1 string, n2 string, n3 string, p1 smallint, p2 smallint, p3 smallint, p0 smallint",
    "e2a_series": "narrative_id string, win long, y255 long, m255 long",
    "e2a_lineage": "win long, kind string, parents array<string>, children array<string>, shares array<double>",
    "e2b_series": "narrative_id string, win long, y double, lam double, pit double, burst boolean",
    "e2b_alpha": "target string, source string, win long, alpha double",
    "prices_daily": "symbol string, date string, open long, high long, low long, close long, volume long",
    "prices_actions": "symbol string, date string, kind string, value double",
    "embeddings": "observation_id string, vec array<tinyint>",
}


def conforms(df: DataFrame, table: str) -> DataFrame:
    """df in the table's columns and types; a missing column or another type is an error, a further column goes."""
    want = StructType.fromDDL(TABLES[table])
    have = dict(df.dtypes)
    for f in want.fields:
        if have.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"{table}.{f.name}: {have.get(f.name)} instead of {f.dataType.simpleString()}")
    return df.select(*want.fieldNames())


def membership_faults(memberships: DataFrame) -> DataFrame:
    """Rows whose shares aren't whole 255ths in sum."""
    return memberships.where(F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3") != 255)


def alpha_faults(alpha: DataFrame) -> DataFrame:
    """Targets and windows whose shares, without a floor, don't sum to one."""
    return alpha.groupBy("target", "win").agg(F.sum("alpha").alias("s")).where(F.abs(F.col("s") - 1) > 1e-6)
