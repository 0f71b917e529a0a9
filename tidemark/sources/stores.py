"""Tables by day, content-addressed files, snapshots, cases (SRC-07, SRC-13..17, SRC-23, SRC-28..29, SNK-01..10)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str) -> None:
    """SNK-01: one folder per day, zstd; days that df has are overwritten, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def register(spark: SparkSession, root: str, names: list[str]) -> None:
    """SRC-16: a view for each table folder."""
    for n in names:
        spark.read.parquet(f"{root}/{n}").createOrReplaceTempView(n)


def blob_path(digest: str, suffix: str = "") -> str:
    return f"{digest[:2]}/{digest[2:4]}/{digest}{suffix}"


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: (path, sha256, content, named_right): files whose name is their content's digest."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    return f.select("path", digest.alias("sha256"), "content", F.substring_index("path", "/", -1).startswith(digest).alias("named_right"))


def search_key(params: dict) -> str:
    """SRC-23: the name of an archived response."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(key, position, title, link) of archived search responses."""
    raw = spark.read.schema("organic_results array<struct<position: int, title: string, link: string>>").option("multiLine", "true").json(path).select(F.element_at(F.split(F.element_at(F.split("_metadata.file_name", "/"), -1), "\\."), 1).alias("key"), F.explode("organic_results").alias("r"))
    return raw.select("key", "r.*")


def snapshot_id(config: str, window: int, parent: str, inputs: str) -> str:
    """SNK-05: a name that its contents and its parent determine."""
    h = hashlib.sha256()
    for part in (config, str(window), parent, inputs):
        b = part.encode()
        h.update(len(b).to_bytes(8, "big") + b)
    return h.hexdigest()


def write_snapshot(state: dict[str, DataFrame], root: str, config: str, window: int, parent: str) -> str:
    """Each state table under the snapshot's name, then its manifest row; the name covers every table's rows in any order."""
    spark = next(iter(state.values())).sparkSession
    digests = []
    for n, df in sorted(state.items()):
        r = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
        digests.append(f"{n}:{r[0]}:{r[1]}")
    name = snapshot_id(config, window, parent, "|".join(digests))
    for n, df in state.items():
        df.write.mode("overwrite").parquet(f"{root}/{n}/snapshot_id={name}")
    spark.createDataFrame([(name, config, window, parent, "|".join(digests))], "snapshot_id string, cfg string, win long, parent string, inputs string").write.mode("append").parquet(f"{root}/manifest")
    return name


def read_snapshot(spark: SparkSession, root: str, table: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}/snapshot_id={name}")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-29: (case_id, status, tau_star, fired) of files named by a day; a broken one is UNREADABLE."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.regexp_extract("path", "([0-9]{4}-[0-9]{2}-[0-9]{2})\\.json$", 1)
    body = F.from_json(F.col("content").cast("string"), "day string, tau_star string, fired array<string>")
    f = f.select(name.alias("case_id"), body.alias("b")).where("case_id <> ''")
    return f.select("case_id", F.when(F.col("b").isNull() | F.col("b.day").isNull(), "UNREADABLE").otherwise("OK").alias("status"), "b.tau_star", "b.fired")


def dossier(case: dict) -> str:
    """SNK-08: a case in Markdown."""
    lines = [f"# {case['day']}", "", f"Cutoff: {case.get('tau_star') or 'none'}", "", "| symbol | R | SAR | fired |", "|---|---|---|---|"]
    lines += [f"| {s['symbol']} | {s['R']:+.2%} | {s['SAR']:.1f} | {'yes' if s['fired'] else 'no'} |" for s in case.get("stats", [])]
    for h in case.get("verdicts", []):
        lines += ["", f"## {h['hypothesis']}: {h['label']}", "", f"Readings: {h['readings']}"]
    return "\n".join(lines) + "\n"


def placebo_misses(wanted: DataFrame, memo: DataFrame, key: str = "memo_key") -> DataFrame:
    """SNK-10: what the memo doesn't hold yet."""
    return wanted.join(memo.select(key), key, "left_anti")
