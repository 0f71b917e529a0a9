"""Near-duplicates by exact similarity: word shingles whose sets have a Jaccard index of ALIKE or more.

Candidates share a SimHash component (the Gray-order index) or a band of min-hashes; of the latter
each pair is held against the whole shingle sets, unless both are of one component by then.
A pair at 0.8 shares none of the bands with a chance of 0.0004.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, per_batch, quoted, utf8, with_key
from tidemark.llm.simhash import SEED, link_edges, simhash
from tidemark.operators.components import connected_components
from tidemark.session import written

SIZE, ALIKE = 5, 0.8
BANDS, ROWS = 20, 5
#: Shingles whose min-hashes are taken at once.
STEP = 1 << 12
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; those that simhash sums."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(words) - size + 1)], ends[min(size, len(words)) - 1 :]
    d = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((d(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def digest(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 3)).view(np.int64))


def bands(h: np.ndarray) -> list[int]:
    """A hash per band of min-hashes; none of an empty set."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), STEP):
        x = h[at : at + STEP, None] * _A + _B
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), i)).view(np.int64)) for i, r in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(size: int):
    def make():
        def f(b: pa.RecordBatch):
            fps, sets, at, n = [], [], [], []
            for t in utf8(b.column(1)):
                h = shingles(t, size)
                fps.append(int(np.uint64(simhash(t, size)).view(np.int64)))
                sets.append(digest(h))
                at.append(bands(h))
                n.append(len(h))
            return [b.column(0), fps, sets, at, n]

        return f

    return make


def _sets(size: int):
    def make():
        def f(b: pa.RecordBatch):
            each = [shingles(t, size) for t in utf8(b.column(0))]
            return [[digest(h) for h in each], [h.view(np.int64) for h in each]]

        return f

    return make


def _verified(pairs: DataFrame, sets: DataFrame, least: float, name: str) -> DataFrame:
    """Of (a, b) those whose sets are alike."""
    side = lambda x: sets.select(F.col("s").alias(x), F.col("h").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return written(both.where(F.col("i") >= least * (F.size("ha") + F.size("hb") - F.col("i"))).select("a", "b"), name)


def alike_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, least: float = ALIKE) -> DataFrame:
    """(key, component_id) per row of docs; component_id is the least key reachable by links, null where no member has a key.

    Texts are linked where their SimHashes are (see simhash.near_duplicates), or where their sets of
    shingles are alike. Rows without a key are linked by the former only.
    """
    sk = written(per_batch(docs.select(col(key), col(text)), _sketches(size), with_key(docs, key, "fp long, s long, bands array<long>, n int")).withColumnRenamed(key, "_key"), "alike-sketches")
    # as tables, so that joins stand on two plain exchanges, which AQE may split
    near = connected_components(written(link_edges(written(sk.select("fp").distinct(), "alike-prints")).distinct(), "alike-print-edges"), name="alike-print-components")
    rooted = written(sk.select("fp", "s").distinct().join(near.withColumnRenamed("node", "fp"), "fp", "left").select("s", F.coalesce("component", "fp").alias("root")).distinct(), "alike-roots")
    links = written(rooted.join(written(rooted.groupBy("root").agg(F.min("s").alias("b")), "alike-least"), "root").where("s <> b").select(F.col("s").alias("a"), "b").distinct(), "alike-print-links")

    one = written(sk.where(F.col("_key").isNotNull() & (F.col("n") > 0)).groupBy("s").agg(F.min("_key").alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands")), "alike-distinct")
    at = one.select("s", "n", F.explode("bands").alias("band"))
    shared = written(at.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "alike-bands")
    members = written(at.join(shared, "band"), "alike-members")
    wanted = written(one.join(members.select("s").distinct(), "s", "left_semi").select(F.col("k").alias("_k")), "alike-wanted")
    sets = written(per_batch(docs.join(wanted, docs[quoted(key)] == wanted["_k"], "left_semi").select(col(text)), _sets(size), "s long, h array<long>").dropDuplicates(["s"]), "alike-sets")
    close = F.least("n", "m") >= least * F.greatest("n", "m")
    # each text meets the least of its bands' first ones
    hubs = members.join(written(members.groupBy("band").agg(F.min(F.struct("s", "n")).alias("hub")), "alike-hubs"), "band").select(F.col("hub.s").alias("a"), F.col("hub.n").alias("m"), F.col("s").alias("b"), "n")
    tested = written(hubs.where((F.col("a") < F.col("b")) & close).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "alike-pairs")
    links = links.unionByName(_verified(tested, sets, least, "alike-links"))
    found = written(connected_components(links, name="alike-components"), "alike-found")
    # then all pairs of a band that lie in two components
    now = written(members.join(found.withColumnRenamed("node", "s"), "s", "left").select("band", "s", "n", F.coalesce("component", "s").alias("c")), "alike-labels")
    parts = now.groupBy("band", "c").agg(F.lit(1).alias("one"))
    parts = written(parts.join(parts.groupBy("band").count().where("count > 1"), "band").select("band", "c"), "alike-parts")
    if parts.take(1):
        two = parts.join(parts.withColumnRenamed("c", "d"), "band").where("c < d")
        met = two.join(now, ["band", "c"]).join(now.select("band", F.col("c").alias("d"), F.col("s").alias("z"), F.col("n").alias("m")), ["band", "d"]).where(close)
        pairs = met.select(F.least("s", "z").alias("a"), F.greatest("s", "z").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        more = _verified(written(pairs, "alike-pairs"), sets, least, "alike-links")
        if more.take(1):
            found = written(connected_components(links.unionByName(more), name="alike-components"), "alike-found")
    labels = written(sk.groupBy("s").agg(F.min("_key").alias("k")).join(found.withColumnRenamed("node", "s"), "s", "left").select("s", "k", F.coalesce("component", "s").alias("c")), "alike-ends")
    first = written(labels.groupBy("c").agg(F.min("k").alias("component_id")), "alike-first")
    return sk.select("_key", "s").join(labels.select("s", "c"), "s").join(first, "c").select(F.col("_key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, least: float = ALIKE) -> DataFrame:
    """The rows of docs whose key is their component's id: one document of each group of near-duplicates.

    Rows that repeat the kept key are one document and stay together; rows with a null key stay.
    """
    first = written(alike_groups(docs, key, text, size, least).where(col(key) == F.col("component_id")).select(F.col("component_id").alias("_kept")).distinct(), "alike-kept")
    return docs.join(first, docs[quoted(key)] == first["_kept"], "left_semi").unionByName(docs.where(col(key).isNull()))
