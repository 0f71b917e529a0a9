"""Recorded results against results worked out anew (VER-01)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.search import empirical_p
from tidemark.operators.verdicts import redacted


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault): files (path, content) whose SHA-256 isn't the manifest's (path, sha256), or which only one of them has."""
    f = files.select("path", F.sha2("content", 256).alias("have"))
    j = f.join(manifest, "path", "full_outer")
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("have") != F.col("sha256"), "changed")
    return j.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("path", "fault")


def same(recorded: DataFrame, again: DataFrame) -> bool:
    return recorded.exceptAll(again).isEmpty() and again.exceptAll(recorded).isEmpty()


def placebo_agrees(report: dict) -> bool:
    """A report {real, placebos, p} says the p that its own costs give."""
    return abs(empirical_p(report["real"], report["placebos"]) - report["p"]) < 5e-4


def archive_clean(response: dict) -> bool:
    """Nothing sensitive was kept."""
    return redacted(response) == response


def run(checks: dict[str, Callable[[], bool]]) -> list[tuple[str, bool, str]]:
    """(name, passed, why not) of each check; one that raises has failed."""
    out = []
    for name, f in checks.items():
        try:
            out.append((name, bool(f()), ""))
        except Exception as e:  # a check that can't be made is a failed one
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out


def digest(spark: SparkSession, path: str) -> str:
    """A name for a table's rows, in whatever order or files."""
    df = spark.read.parquet(path)
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r[0]}|{r[1]}".encode()).hexdigest()
