"""Manifests and zipped tab-separated batches (SRC-01..12, SCA-16..20)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, text

# File suffixes of the three kinds, their order within a batch, and fields in a line.
SUFFIXES = {"gkg.csv.zip": "gkg", "export.CSV.zip": "export", "mentions.CSV.zip": "mentions"}
ORDER = {"gkg": 0, "export": 1, "mentions": 2}
FIELDS = {"gkg": 27, "export": 61, "mentions": 16}


def manifest(lines: DataFrame, line: str = "value") -> DataFrame:
    """SRC-01: (size, md5, url, batch_ts, kind) of well-formed lines; others, and other streams' files, have no row."""
    p = F.split(F.trim(F.regexp_replace(line, "\\s+", " ")), " ")
    m = lines.select("*", p.alias("_p")).where(F.size("_p") == 3)
    name = F.substring_index(F.get("_p", F.lit(2)), "/", -1)
    m = m.withColumns({"batch_ts": F.substring_index(name, ".", 1), "_suffix": F.regexp_replace(name, "^[^.]*\\.", "")})
    kind = F.coalesce(*[F.when(F.col("_suffix") == s, k) for s, k in SUFFIXES.items()])
    size = F.get("_p", F.lit(0))
    m = m.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("batch_ts").rlike("^[0-9]{14}$") & size.rlike("^[0-9]+$"))
    return m.select(*[c for c in lines.columns if c != line], size.cast("long").alias("size"), F.lower(F.get("_p", F.lit(1))).alias("md5"), F.regexp_replace(F.get("_p", F.lit(2)), "^http://", "https://").alias("url"), "batch_ts", "kind")


def plan(entries: DataFrame, start: str, end: str, seq: str, kinds: tuple[str, ...] = tuple(ORDER)) -> DataFrame:
    """SRC-02: the last entry of each batch and kind in [start, end), in order."""
    inside = entries.where((F.col("batch_ts") >= start) & (F.col("batch_ts") < end) & F.col("kind").isin(*kinds))
    last = inside.withColumn("_n", F.row_number().over(W.partitionBy("batch_ts", "kind").orderBy(F.desc(seq)))).where("_n = 1").drop("_n")
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in ORDER.items()])
    return last.orderBy("batch_ts", rank)


def latest(ledger: DataFrame, key: str, seq: str) -> DataFrame:
    """SRC-05: the record of each key with the largest sequence number."""
    others = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("r")).select(key, "r.*")


def outstanding(planned: DataFrame, ledger: DataFrame, key: str = "url") -> DataFrame:
    """SRC-04, SET-04: planned entries without a good record."""
    return planned.join(ledger.where(F.col("status").isin("ok", "missing")).select(key), key, "left_anti")


def verified(files: DataFrame, entries: DataFrame) -> DataFrame:
    """SRC-03: files (url, content) whose MD5 is the manifest's."""
    return files.join(entries.select("url", "md5"), "url").where(F.md5("content") == F.col("md5"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, line_no, line) of one-member zip files, without empty lines; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    rows = [(i, x) for i, x in enumerate(z.read(z.namelist()[0]).decode("utf-8", "replace").split("\n")) if x]
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(rows), pa.string()), pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.string())], names=["path", "line_no", "line"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, "path string, line_no int, line string")


def _cut(lines: DataFrame, kind: str) -> DataFrame:
    return lines.withColumn("c", F.split("line", "\t", -1)).where(F.size("c") == FIELDS[kind])


def quarantine(lines: DataFrame, kind: str) -> DataFrame:
    """SRC-11: lines with a wrong number of fields."""
    n = F.size(F.split("line", "\t", -1))
    return lines.where(n != FIELDS[kind]).select(F.lit(kind).alias("kind"), "line_no", n.alias("n_fields"), F.substring("line", 1, 2000).alias("raw_line"))


def _c(i: int) -> Column:
    return F.get("c", F.lit(i))


def _xml(tag: str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text.unescape_udf(F.regexp_extract(_c(26), f"(?s)<{tag}>(.*?)</{tag}>", 1)), "\\s+", " ")), F.lit(""))


def gkg(lines: DataFrame) -> DataFrame:
    """SRC-08: observations, one row per line of 27 fields."""
    parts = lambda i, sep: F.split(_c(i), sep, -1)
    countries = F.transform(parts(9, ";"), lambda x: F.coalesce(F.get(F.split(x, "#", -1), F.lit(2)), F.lit("")))
    names = F.transform(parts(23, ";"), lambda x: F.regexp_replace(x, ",[^,]*$", ""))
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.flatten(F.transform(a, lambda x: F.split(x, ";", -1))), lambda x: F.trim(x)), lambda x: x != ""))
    quotes = F.transform(parts(22, "#"), lambda q: F.struct(F.trim(F.get(F.split(q, "\\|", 4), F.lit(2))).alias("verb"), F.trim(F.get(F.split(q, "\\|", 4), F.lit(3))).alias("quote")))
    amounts = F.transform(F.filter(parts(24, ";"), lambda a: F.size(F.split(a, ",", -1)) >= 3), lambda a: F.struct(F.substring_index(a, ",", 1).try_cast("double").alias("amount"), F.trim(F.regexp_extract(a, "^[^,]*,(.*),[^,]*$", 1)).alias("object")))
    tone = parts(15, ",")
    return _cut(lines, "gkg").select(
        _c(0).alias("record_id"), clock.parse_stamp(_c(1)).alias("batch_ts"), _c(2).try_cast("tinyint").alias("source_collection"), F.lower(_c(3)).alias("source_name"), _c(4).alias("url"), _xml("PAGE_TITLE").alias("title"),
        clock.parse_stamp(_xml("PAGE_PRECISEPUBTIMESTAMP")).alias("published_time"), text.split_list(_xml("PAGE_AUTHORS"), ",").alias("authors"), text.split_list(_c(7), ";").alias("themes"), clean(countries).alias("countries"),
        text.split_list(_c(11), ";").alias("persons"), text.split_list(_c(13), ";").alias("orgs"), clean(names).alias("all_names"), F.get(tone, F.lit(0)).try_cast("float").alias("tone"), F.get(tone, F.lit(6)).try_cast("int").alias("word_count"),
        _c(18).alias("sharing_image"), F.filter(quotes, lambda q: F.coalesce(q["quote"], F.lit("")) != "").alias("quotations"), F.filter(amounts, lambda a: a["amount"].isNotNull()).alias("amounts"),
    ).withColumn("url_key", text.url_key(F.col("url")))


def exports(lines: DataFrame) -> DataFrame:
    """SRC-09: events, one row per line of 61 fields."""
    return _cut(lines, "export").select(
        _c(0).try_cast("long").alias("event_id"), _c(1).alias("day"), _c(6).alias("actor1"), _c(16).alias("actor2"), _c(26).alias("event_code"), _c(30).try_cast("float").alias("goldstein"), _c(31).try_cast("int").alias("num_mentions"),
        _c(32).try_cast("int").alias("num_sources"), _c(33).try_cast("int").alias("num_articles"), _c(34).try_cast("float").alias("avg_tone"), _c(53).alias("country"), clock.parse_stamp(_c(59)).alias("date_added"), _c(60).alias("source_url"),
    )


def mentions(lines: DataFrame) -> DataFrame:
    """SRC-10: mentions, one row per line of 16 fields."""
    return _cut(lines, "mentions").select(
        _c(0).try_cast("long").alias("event_id"), clock.parse_stamp(_c(1)).alias("event_time"), clock.parse_stamp(_c(2)).alias("mention_time"), _c(3).try_cast("tinyint").alias("mention_type"), F.lower(_c(4)).alias("source_name"), _c(5).alias("url"), _c(11).try_cast("smallint").alias("confidence"),
    )


def complete_days(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """PF-10, JOIN-16: (day, complete, in_prefix): whether all planned files are there, and whether all days before are complete too."""
    s = planned.join(ledger.select("url", "status"), "url", "left").withColumn("day", F.substring("batch_ts", 1, 8))
    d = s.groupBy("day").agg(F.bool_and(F.coalesce(F.col("status").isin("ok", "missing"), F.lit(False))).alias("complete"))
    return d.withColumn("in_prefix", F.bool_and("complete").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))  # one row per day


def days_of_windows(first: int, last: int, origin: str = clock.ORIGIN) -> Column:
    """A predicate on `day` that goes with a range of windows, so that partitions are pruned."""
    at = lambda w: F.to_date(clock.window_start(F.lit(w), origin))
    return F.col("day").between(at(first), at(last))
