"""SimHash near-duplicates over a hierarchical index in Gray order.

Fingerprints within a distance of d agree on whole blocks of bits, so each distinct one goes,
under every choice of blocks, to the node of its pattern there. Inside a node fingerprints are
sorted by Gray rank, and a tree is laid over runs of them: every tree node keeps the bits that all
below it share, as a mask and a pattern. Pairs of nodes are followed from the top; differences on
newly shared bits add up, and a pair of groups is left as soon as they exceed d, or once both
groups lie in one component. Components then join across nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, per_batch, quoted, utf8, with_key
from tidemark.operators.components import connected_components
from tidemark.session import written

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Blocks of bits; d of them may differ, so every choice of BLOCKS - d of them is a top level of the index.
BLOCKS = 6
FAN = 8
#: Pairs of nodes followed at once, and distinct fingerprints of one pattern that one task takes.
PAIRS, FRAGMENT = 1 << 14, 50_000
#: Hashes whose bits are summed at once.
HASHES = 1 << 16


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """Bit i is 1 if over half of the shingles' XXH64 have it; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(words) - size + 1)], ends[min(size, len(words)) - 1 :]
    d, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES):
        s, e = starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist()
        h = np.fromiter((d(line[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, len(s))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit integer. Null and wordless texts have 0."""
    return per_batch(docs.select(col(key), col(text)), lambda: lambda b: [b.column(0), np.array([simhash(t, size) for t in utf8(b.column(1))], np.uint64).view(np.int64)], with_key(docs, key, "fp long"))


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits of every choice of blocks that agree in a pair at this distance."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - distance)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """A code word's place in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Links:
    """Disjoint sets over row numbers; a set's label is its least row."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.label
        while True:
            x, y = p[a], p[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p[:] = q


def link(groups: np.ndarray, values: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Labels by which equal groups' values are linked at this distance, directly or through others.

    Sorted by group, then Gray rank. The work on a dense group stays near its size: pairs of nodes
    already in one component are left out as the links come in.
    """
    n = len(values)
    sets = Links(n)
    if n < 2:
        return sets.label
    low, high, first = [values], [values], [np.arange(n)]  # per level: AND, OR, first child
    group = [groups]
    while True:
        g = group[-1]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        if len(starts) == len(g):
            break
        run = np.arange(len(g)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(g)]))))
        heads = np.flatnonzero(run % FAN == 0)
        low.append(np.bitwise_and.reduceat(low[-1], heads))
        high.append(np.bitwise_or.reduceat(high[-1], heads))
        first.append(np.concatenate((heads, [len(g)])))
        group.append(g[heads])
    top = len(low) - 1
    leaves = [np.arange(n + 1)]
    for f in first[1:]:
        leaves.append(leaves[-1][f])
    zero = np.zeros(len(low[top]), np.uint64)
    many = np.flatnonzero(np.diff(leaves[top]) > 1)
    work = [(top, many, many, zero[many].astype(np.int64), zero[many])] if top else []
    while work:
        level, a, b, far, seen = work.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            work += [(level, a[half:], b[half:], far[half:], seen[half:]), (level, a[:half], b[:half], far[:half], seen[:half])]
            continue
        open_ = ~_done(sets.label, leaves[level], a, b)  # links may have come in since it was put here
        a, b, far, seen = a[open_], b[open_], far[open_], seen[open_]
        if not len(a):
            continue
        # pairs of children; of a node with itself, each pair once
        f, under = first[level], level - 1
        na, nb = f[a + 1] - f[a], f[b + 1] - f[b]
        row = np.repeat(np.arange(len(a)), na * nb)
        at = np.arange(len(row)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        ca, cb = f[a][row] + at // nb[row], f[b][row] + at % nb[row]
        keep = (a != b)[row] | (ca <= cb)
        if under == 0:
            keep &= ca != cb
        row, ca, cb = row[keep], ca[keep], cb[keep]
        la, ha, lb, hb = low[under][ca], high[under][ca], low[under][cb], high[under][cb]
        shared = ~(la ^ ha) & ~(lb ^ hb)
        far = far[row] + np.bitwise_count((la ^ lb) & shared & ~seen[row]).astype(np.int64)
        near = far <= distance
        ca, cb, far, shared = ca[near], cb[near], far[near], shared[near]
        if under == 0:
            sets.join(ca, cb)
            continue
        # groups with themselves last in, so first out: close links make the rest of the pairs needless
        order = np.argsort(ca == cb, kind="stable")
        half = int((ca != cb).sum())
        for part in (order[:half], order[half:]):
            if len(part):
                work.append((under, ca[part], cb[part], far[part], shared[part]))
    return sets.label


def _done(label: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of nodes whose rows are all of one component already."""
    least, most = np.minimum.reduceat(label, first[:-1]), np.maximum.reduceat(label, first[:-1])
    return (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])


def _node_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows that are sorted by (m, p, a, b): whole nodes at a time, each value to its component's first."""
    held: list[pa.Table] = []

    def edges(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(i).to_numpy() for i in range(4)]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], 0)))
        group, value = np.cumsum(new), t.column(4).to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(value), group))
        group, value = group[order], value[order]
        label = link(group, value)
        away = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(value[away].view(np.int64)), pa.array(value[label[away]].view(np.int64))], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        same = np.all([t.column(i).to_numpy() == t.column(i)[-1].as_py() for i in range(4)], 0)
        last = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if last == 0 and held and all(held[-1].column(i)[-1].as_py() == t.column(i)[-1].as_py() for i in range(4)):
            held.append(t)
            continue
        # a row from which on everything belongs to the last node, which may go on in the next batch
        if last:
            yield edges(pa.concat_tables([*held, t.slice(0, last)]))
        elif held:
            yield edges(pa.concat_tables(held))
        held = [t.slice(last)]
    if held:
        yield edges(pa.concat_tables(held))


def link_edges(values: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """(a, b) edges among the distinct values of column fp whose components are those of all pairs within DISTANCE.

    A pattern shared by more than `fragment` values is dealt out in fragments, and every two of
    them meet in a task of their own. Tables of patterns are only counted where a block of bits
    alone has that many values.
    """
    each = masks()
    nodes = values.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("p")) for i, m in enumerate(each)])).alias("x")).select("x.m", "x.p", "fp")
    blocks = masks(BLOCKS, BLOCKS - 1)
    counts = values.select(F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("p")) for i, m in enumerate(blocks)])).alias("x")).groupBy("x").count()
    most = counts.agg(F.max("count")).first()[0] or 0
    zero = F.lit(0)
    if most <= fragment:
        dealt = nodes.select("m", "p", zero.alias("a"), zero.alias("b"), "fp")
    else:
        hot = nodes.groupBy("m", "p").count().where(F.col("count") > fragment).select("m", "p", F.ceil(F.col("count") / fragment).cast("int").alias("s"))
        own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        cells = F.transform(F.sequence(zero, F.col("s") - 1), lambda g: F.struct(F.least(own, g).alias("a"), F.greatest(own, g).alias("b")))
        dealt = nodes.join(hot, ["m", "p"], "left").withColumn("s", F.coalesce("s", F.lit(1))).select("m", "p", "fp", F.explode(cells).alias("c")).select("m", "p", "c.a", "c.b", "fp")
    dealt = dealt.repartition("m", "p", "a", "b").sortWithinPartitions("m", "p", "a", "b")
    return dealt.select("m", "p", "a", "b", "fp").mapInArrow(_node_edges, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, fragment: int = FRAGMENT) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id (the least key reachable by links).

    Equal fingerprints are one node, so exact copies never form pairs. Null and wordless texts
    have fingerprint zero and link as any other; null keys get their component's id, which is null
    only where no member has a key; rows that repeat a key are each a row.
    """
    fps = written(fingerprints(docs, key, text, size), "simhash-fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(col(key)).alias("least")), "simhash-distinct")
    edges = written(link_edges(distinct.select("fp"), fragment).distinct(), "simhash-edges")
    # each side of a join is a table or a plain scan, so that AQE may split it at a large component or a hot fingerprint
    found = written(connected_components(edges, name="simhash-components"), "simhash-found")
    rooted = written(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-rooted")
    roots = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    by_fp = written(rooted.join(roots, "root").select("fp", "component_id"), "simhash-components-of")
    return fps.join(by_fp, "fp").select(col(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of docs whose key is their component's id: one document of each group of near-duplicates.

    Rows that repeat the kept key are one document and stay together. Rows with a null key can't be
    named as the one that stays, so all of them do. Any columns are returned as they were.
    """
    first = near_duplicates(docs, key, text, size).where(col(key) == F.col("component_id")).select(F.col("component_id").alias("_kept")).distinct()
    first = written(first, "simhash-kept")
    return docs.join(first, docs[quoted(key)] == first["_kept"], "left_semi").unionByName(docs.where(col(key).isNull()))
