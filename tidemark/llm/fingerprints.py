"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

Blank lines part sections, line ends part paragraphs, and a paragraph is cut into runs of eight
words with all the white space around them. A run's digest is a leaf. A paragraph's digest is the
SHA-256 of the text that its leaves make up, a section's is over its paragraphs', the root over the
sections'. So equal roots mean equal texts, and unequal branches show where an edit is. All of it is
DataFrame expressions.

A fingerprint reads root:leaves,leaves;leaves with 8 hex digits for each leaf, paragraphs parted
by commas and sections by semicolons. Leaves are 32 bits wide: they locate edits and give the
likeness, while equality rests on the root alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col
from tidemark.session import written

RUN = r"(?:\s*+\S++){1,8}|\s++"
LEAF = 8


def _leaf(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), LEAF, "0")


def sections(text: Column) -> Column:
    """Sections of paragraphs. Null is the empty text, which has one empty paragraph."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.split(s, "\n", -1))


def leaves(parts: Column) -> Column:
    """Sections of paragraphs, each the string of its leaves' digests."""
    return F.transform(parts, lambda s: F.transform(s, lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(RUN), F.lit(0)), _leaf), "")))


def root(parts: Column) -> Column:
    """32 hex digits over the section digests, each over its paragraphs' digests."""
    section = lambda s: F.sha2(F.array_join(F.transform(s, lambda p: F.sha2(p.cast("binary"), 256)), ",").cast("binary"), 256)
    return F.substring(F.sha2(F.array_join(F.transform(parts, section), ",").cast("binary"), 256), 1, 32)


def fingerprint(text: Column) -> Column:
    parts = sections(text)
    return F.concat(root(parts), F.lit(":"), F.array_join(F.transform(leaves(parts), lambda s: F.array_join(s, ",")), ";"))


def leaf_set(printed_tree: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(printed_tree, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the nodes in common over the nodes of both, a fingerprint's nodes being its root and its distinct leaves. 1 just for equal texts."""
    x, y = leaf_set(a), leaf_set(b)
    same = (F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)).cast("int")
    return F.when(same == 1, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y) + 2))


def differing_branches(a: Column, b: Column) -> Column:
    """(section, paragraph) of every paragraph whose leaves aren't the other's at that place; equal sections are passed over whole."""
    side = lambda t: F.split(F.substring_index(t, ":", -1), ";", -1)

    def paragraphs(s: Column, i: Column) -> Column:
        x, y = F.split(F.coalesce(s["a"], F.lit("")), ",", -1), F.split(F.coalesce(s["b"], F.lit("")), ",", -1)
        same = F.coalesce(s["a"], F.lit("\0")) == F.coalesce(s["b"], F.lit("\0"))
        pairs = F.transform(F.arrays_zip(x.alias("a"), y.alias("b")), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (~p["a"].eqNullSafe(p["b"])).alias("differs")))
        return F.when(same, F.filter(pairs, lambda p: F.lit(False))).otherwise(F.filter(pairs, lambda p: p["differs"]))

    found = F.flatten(F.transform(F.arrays_zip(side(a).alias("a"), side(b).alias("b")), paragraphs))
    return F.transform(found, lambda p: F.struct(p["section"], p["paragraph"]))


def next_keys(docs: DataFrame, key: str, per_range: int = 50_000) -> DataFrame:
    """(key, following): each distinct key with the next larger one, the largest with the least. Keys of any type that has an order.

    Keys are parted into ranges of about per_range, however many these are, so no task holds them
    all; only one row per range goes through a single task. Null is no key.
    """
    from pyspark.sql import Window

    keys = written(docs.select(col(key).alias("k")).where(F.col("k").isNotNull()).distinct(), "fingerprint-keys")
    parts = max(1, -(-keys.count() // per_range))
    # bounds come from a sample of the keys themselves; written, so that a range's number is the same in both uses
    keys = written(keys.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()), "fingerprint-ranges")
    firsts = keys.groupBy("part").agg(F.min("k").alias("first"))
    over = Window.orderBy("part")  # one row per range of keys
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(over), F.min("first").over(Window.partitionBy())).alias("beyond"))
    inside = keys.select("k", "part", F.lead("k").over(Window.partitionBy("part").orderBy("k")).alias("after"))
    return inside.join(firsts, "part").select(F.col("k").alias(key), F.coalesce("after", "beyond").alias("following"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", per_range: int = 50_000) -> DataFrame:
    """One row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or
    all, of the next document's text, ascending key; after the last comes the first. Null text is
    empty. Rows that repeat a key all have the same next document, and stand as one with the
    least of their texts where they are the next; a null key has an empty next document. An empty
    table gives no rows, and a single document is its own next one.

    A text's tree is made once; only the part of a text that its predecessor needs moves besides the
    text itself, and the next document's fingerprint instead of its text.
    """
    every = docs.select(col(key).alias("k"), F.coalesce(col(text), F.lit("")).alias("t"))
    rows = every.where(F.col("k").isNotNull())
    order = written(next_keys(docs, key, per_range).select(col(key).alias("k"), "following"), "fingerprint-order")
    # what a document sends back: its first code points, as many as the longest row before it can use
    most = written(rows.groupBy("k").agg(F.max(F.char_length("t")).alias("most")), "fingerprint-lengths")
    asks = written(order.join(most, "k").select(F.col("following").alias("k"), F.col("k").alias("to"), F.floor(F.col("most") / 4).cast("int").alias("take")), "fingerprint-asks")
    heads = rows.join(asks, "k").select("to", F.substring(F.col("t"), F.lit(1), F.col("take")).alias("head"), F.sha2(F.col("t").cast("binary"), 256).alias("tie"))
    heads = heads.groupBy(F.col("to").alias("k")).agg(F.min_by("head", "tie").alias("head"))
    both = rows.join(heads, "k", "left").unionByName(every.where(F.col("k").isNull()).withColumn("head", F.lit(None).cast("string")))
    cut = F.floor(F.col("n") / 4).cast("int")
    both = both.withColumn("n", F.char_length("t").cast("long"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n") - cut).cast("int")), F.substring(F.coalesce(F.col("head"), F.lit("")), F.lit(1), cut)))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    prints = written(both.select("k", "n", sha("t").alias("tie"), sha("edited").alias("edited_sha256"), fingerprint(F.col("t")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint")), "fingerprint-trees")
    beyond = prints.join(order.select(F.col("following").alias("k"), F.col("k").alias("to")), "k").groupBy(F.col("to").alias("k")).agg(F.min_by("fingerprint", "tie").alias("next_print"))
    out = prints.join(beyond, "k", "left").withColumn("next_print", F.coalesce("next_print", fingerprint(F.lit(""))))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
