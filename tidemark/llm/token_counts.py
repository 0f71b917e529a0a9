"""Token counts by a digest cache.

A count is kept under the digest of the normalised content and the digest of the tokenizer's own
file. A run joins its documents to the stored counts, encodes one text of each digest that is
missing, and appends those counts to the cache, from which all documents are then answered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import col, per_batch, tokenizer_bytes, tokenizer_path
from tidemark.session import shared_dir, written

CACHE = "version string, digest binary, n_tokens long"
#: Digests that a task remembers before it forgets them all and starts anew.
REMEMBERED = 200_000


def tokenizer_version(name: str) -> str:
    return hashlib.sha256(tokenizer_bytes(name)).hexdigest()


def counter(name: str):
    """A function from a list of texts to their token counts, as the file's own library gives them."""
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(sp.encode(x, num_threads=1)) for x in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    raise ValueError(f"no library for {name}")


def _content(text: str):
    """The normalised content. The counters read every code point, so only null changes: it is empty."""
    return F.coalesce(col(text), F.lit(""))


def _digest(text: str):
    return F.unhex(F.sha2(_content(text).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; runs that appended at the same time may have repeated a digest."""
    return spark.read.schema(CACHE).option("pathGlobFilter", "*.parquet").parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, path: str) -> None:
    """Adds rows of CACHE to a cache. A folder for each tokenizer version, so that a run reads its own only."""
    counts.write.mode("append").partitionBy("version").parquet(path)


def compacted(spark: SparkSession, path: str, version: str, new_path: str, digests_per_file: int = 5_000_000) -> None:
    """A version's counts in few files, each digest once, in a new cache folder for later runs: the old one may still be read meanwhile."""
    own = written(read_cache(spark, path, version), "token-counts-own")
    files = max(1, -(-own.count() // digests_per_file))
    append(own.repartition(files, "digest").select(F.lit(version).alias("version"), "digest", "n_tokens"), new_path)


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache_path: a folder that later runs share; None starts an empty one. Null texts are empty
    texts with no tokens; keys may be null or repeated; an empty table gives no rows. Equal texts
    are encoded once, whatever their number: each task sends a digest's text on once, and the
    join back to the documents is one that AQE splits at a hot digest.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    path = cache_path or shared_dir(spark, "token-counts")
    append(spark.createDataFrame([], CACHE), path)
    held = read_cache(spark, path, version)

    def first_seen():
        seen: set[bytes] = set()

        def f(b: pa.RecordBatch):
            keep = []
            for i, d in enumerate(b.column(0).to_pylist()):
                if d not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    keep.append(i)
            return b.take(pa.array(keep, pa.int32())).columns

        return f

    def encode():
        count, last = counter(tokenizer), [None]

        def f(b: pa.RecordBatch):
            digests, texts, new = [], [], b.column(1)
            for i, d in enumerate(b.column(0).to_pylist()):  # sorted: a digest's copies are neighbours
                if d != last[0]:
                    last[0] = d
                    digests.append(d)
                    texts.append(new[i].as_py())
            return [version] * len(digests), digests, count(texts)

        return f

    texts = docs.select(_digest(text).alias("digest"), _content(text).alias("content"))
    misses = per_batch(texts, first_seen, "digest binary, content string").join(held, "digest", "left_anti")
    misses = misses.repartition("digest").sortWithinPartitions("digest")
    append(per_batch(misses, encode, CACHE), path)

    rows = docs.select(col(key), F.octet_length(_content(text)).cast("long").alias("n_bytes"), _digest(text).alias("digest"))
    # as a table, so that the join stands on two plain exchanges, which AQE may split at a hot digest
    counts = written(read_cache(spark, path, version), "token-counts-known")
    return rows.join(counts, "digest").select(col(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
