"""Title vectors: an offline encoder, the day cache, and the verified exchange with another machine (E1-05, E1-07, SRC-17, SNK-02..04)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions import vectors
from tidemark.sources.stores import write_days

DIMS, PARITY, SAMPLE = 64, 0.999, 200


def encode(title: str, dims: int = DIMS) -> np.ndarray:
    """Signed hashes of character trigrams, unit length; an empty title is zero. It stands in for a language model, which this library doesn't bring."""
    v, t = np.zeros(dims), f"  {title.casefold()} "
    for i in range(len(t) - 2):
        h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        v[h % dims] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n and title else np.zeros(dims)


@F.pandas_udf(ArrayType(DoubleType()))
def encode_udf(titles: pd.Series) -> pd.Series:
    """Each distinct title of a batch once."""
    known = {t: encode(t or "").tolist() for t in titles.unique()}
    return titles.map(known)


def embed_roots(docs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(day, observation_id, vec) of roots on days that aren't done, as int8. Titles are encoded once each."""
    roots = docs.where(F.col("copy_group") == F.col("observation_id")).select("day", "observation_id", F.coalesce("title", F.lit("")).alias("title"))
    if done is not None:
        roots = roots.join(done.select("day").distinct(), "day", "left_anti")
    titles = roots.select("title").distinct().withColumn("vec", vectors.to_int8(encode_udf("title")))
    return roots.join(titles, "title").select("day", "observation_id", "vec")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The cache as unit vectors."""
    return spark.read.parquet(path).withColumn("vec", vectors.from_int8(F.col("vec")))


def export_manifest(rows: DataFrame) -> DataFrame:
    """Per day: rows, distinct titles, and a digest of ids and titles in order of id."""
    line = F.concat_ws("\x1f", "observation_id", "title")
    h = F.aggregate(F.array_sort(F.collect_list(F.sha2(line, 256))), F.lit(""), lambda s, x: F.sha2(F.concat(s, x), 256))
    return rows.groupBy("day").agg(F.count("*").alias("n_rows"), F.count_distinct("title").alias("unique_titles"), h.alias("sha256"))


def import_faults(sent: DataFrame, back: DataFrame, dims: int = DIMS) -> DataFrame:
    """(day, fault) of what came back (day, observation_id, vec int8) for what was sent (day, observation_id, title): ids that differ, wrong sizes, or a hashed sample of titles whose own encoding is too far."""
    j = sent.join(back, ["day", "observation_id"], "full_outer")
    ids = j.where(F.col("vec").isNull() | F.col("title").isNull()).select("day", F.lit("ids differ").alias("fault"))
    size = back.where(F.size("vec") != dims).select("day", F.lit("wrong dimension").alias("fault"))
    per_day = sent.groupBy("day").agg(F.count("*").alias("n"))
    s = j.where(F.col("vec").isNotNull() & F.col("title").isNotNull() & (F.size("vec") == dims) & (F.col("title") != "")).join(per_day, "day")
    s = s.where(F.pmod(F.xxhash64("observation_id"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))) == 0)
    far = s.where(F.coalesce(vectors.cosine(vectors.to_int8(encode_udf("title")), F.col("vec")), F.lit(0.0)) < PARITY).select("day", F.lit("parity").alias("fault"))
    return ids.unionByName(size).unionByName(far).distinct()


def install(sent: DataFrame, back: DataFrame, path: str) -> None:
    """All days or none."""
    faults = import_faults(sent, back).limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r.day}: {r.fault}" for r in faults))
    write_days(back, path)
