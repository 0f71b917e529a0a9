"""Session defaults and the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the library's defaults; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset a local session takes a local folder; a cluster has none that all its machines see."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Names of the folders that `written` made, by the table's place, so that `discard` deletes nothing else.
_WRITTEN: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs nothing that was done."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    _WRITTEN.add(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned, once nothing that is still to run reads them."""
    for t in tables:
        path = getattr(t, "_tidemark_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            jvm = t.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
