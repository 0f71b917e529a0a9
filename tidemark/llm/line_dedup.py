"""Line dedup by a log-template tree of fixed depth.

A line is one unit; a long line is cut into units where two neighbouring words say so by their
hash, so that a passage gives the same units in whatever line and at whatever place it stands. A
unit's tokens with digits are variable fields. The path to a leaf is the number of tokens and the
leading ones; in a leaf, units that agree in enough places share a template, whose other places
become variable. A template that occurs in several documents is kept in the first of them, by key.
In the others a line goes whose units all recur, and so does a run of such units inside a line.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import col, in_arrow, per_batch, quoted, utf8
from tidemark.operators.components import connected_components
from tidemark.session import discard, written

#: Leading tokens on a path, share of places that must agree, documents that make a template recur.
DEPTH, ALIKE, MIN_DOCS = 4, 0.8, 2
#: Units that a task remembers (a power of two), and bytes of text that it takes at once.
REMEMBERED, AT_ONCE = 1 << 19, 1 << 18
#: Sightings of lines of one leaf beyond which it is dealt out to several tasks.
HOT_LINES = 200_000
#: Words of the longest line that is one unit; one pair of words in CUT begins a unit in longer ones.
WHOLE, CUT = 24, 8
#: Words of the shortest unit in a long line that is looked up, and of the shortest run that goes from one.
SHORT, RUN = 4, 16
#: Bits of the largest map of paths that tasks hold. It spares the others a shuffle; its errors cost only that.
MAP_BITS = 28

_MASK = (1 << 64) - 1
_BYTES, _WORDS, _PAIRS, _SIZES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FIELD = 0x5DEECE66D
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_PAIRS)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_SIZES)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each run of values, whatever its place: the sum of (value + 1) * base ** (place in the run). Runs are sorted and apart; some are taken at a time."""
        out, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            a = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, a + AT_ONCE, "right")))
            v = values[a : ends[j - 1]].astype(np.uint64) + np.uint64(1)
            if len(v) > len(self.up):
                self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(v), b, np.uint64)))) for b in self.bases)
            total = np.concatenate(([np.uint64(0)], np.cumsum(v * self.up[: len(v)], dtype=np.uint64)))
            out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * self.down[starts[i:j] - a]
            i = j
        return out


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTES), _Powers(_WORDS)


class Units:
    """The units of some texts, all found at once.

    doc and line number each unit's text and its line in that text; begin and end are bytes of the
    text; words from first to last (exclusive) are hashes in `words`; path and name are its keys.
    Those of under SHORT words in a long line stand for nothing: they aren't counted.
    """

    def __init__(self, texts: list[bytes], depth: int = DEPTH) -> None:
        x = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = np.concatenate(([False], ~_SPACE[x], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        h = _BYTE_POWERS.sums(x, starts, ends)
        h = _mixed(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_SIZES)))
        digits = np.concatenate(([0], np.cumsum(_DIGIT[x], dtype=np.int32)))
        h[digits[ends] > digits[starts]] = FIELD
        self.words = h
        lines = np.cumsum(x == 10, dtype=np.int32)
        each = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        before = np.concatenate(([0], np.cumsum(each)))
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        line = lines[starts].astype(np.int64)
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = line[1:] != line[:-1]
        heads = np.flatnonzero(new)
        length = np.diff(np.append(heads, n))
        long = np.repeat(length > WHOLE, length)
        if n:
            pair = _mixed(h[:-1] * np.uint64(_PAIRS) + h[1:])
            new[1:] |= long[1:] & (pair % np.uint64(CUT) == 0)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first, n)[1:].astype(np.int64)
        size = self.last - self.first
        self.counted = (size >= SHORT) | ~long[self.first]
        key = size.astype(np.uint64)
        for d in range(depth):
            at = np.minimum(self.first + d, max(n - 1, 0))
            key = _mixed(key * np.uint64(_WORDS) + np.where(d < size, h[at] if n else np.uint64(0), np.uint64(0)))
        self.path = key.view(np.int64)
        self.name = _mixed(_WORD_POWERS.sums(h, self.first, self.last) + size.astype(np.uint64)).view(np.int64)
        at = line[self.first]
        self.doc = np.searchsorted(before, at, "right") - 1
        self.line = at - before[self.doc]
        self.begin, self.end = starts[self.first] - offset[self.doc], ends[self.last - 1] - offset[self.doc]

    def of(self, doc: int) -> range:
        lo, hi = np.searchsorted(self.doc, [doc, doc + 1])
        return range(int(lo), int(hi))


def chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts): some texts at a time, a long one alone."""
    held, size, at = [], 0, 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def shortened(text: bytes, u: Units, own: range, going: set[tuple[int, int]], run: int = RUN) -> tuple[bytes, int, int]:
    """(text, lines gone, lines cut): the text without the lines whose units all go, and without runs of at least `run` words that go inside a line.

    A run is made of units that go and of those between them that aren't counted.
    """
    lines: list[bytes | None] = list(text.split(b"\n"))
    base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines]))).tolist()
    by_line: dict[int, list[int]] = {}
    for i in own:
        by_line.setdefault(int(u.line[i]), []).append(i)
    gone = cut = 0
    for n, each in by_line.items():
        goes = [(int(u.path[i]), int(u.name[i])) in going if u.counted[i] else None for i in each]
        if True not in goes:
            continue
        if False not in goes:
            lines[n] = None
            gone += 1
            continue
        raw, out, done, at = lines[n], [], 0, 0
        while at < len(each):
            if goes[at]:
                last = at
                for b in range(at + 1, len(each)):
                    if goes[b] is False:
                        break
                    last = b if goes[b] else last
                if u.last[each[last]] - u.first[each[at]] >= run:
                    out.append(raw[done : int(u.begin[each[at]]) - base[n]])
                    done = (int(u.begin[each[last + 1]]) if last + 1 < len(each) else int(u.end[each[last]])) - base[n]
                at = last
            at += 1
        if out:
            lines[n] = b"".join([*out, raw[done:]])
            cut += 1
    return b"\n".join(x for x in lines if x is not None), gone, cut


class Leaf:
    """The templates of one leaf, and an index of them by runs of places.

    A line lies in a template if they agree in `alike` of their places or more; a template's fields
    agree with nothing. So at most `spare` places differ, and when the places are cut into spare + 1
    runs, a line and its template agree on all of one run. Only templates that a run of the line
    leads to are compared with it: the outcome is that of comparing it with every one.
    """

    def __init__(self, width: int, alike: float, same: int) -> None:
        """The first `same` places are alike in all lines of the leaf and tell nothing apart."""
        self.need = alike * width
        self.runs = _runs(width, alike, same)
        self.names: list[int] = []
        self.table, self.fields = np.zeros((16, width), np.uint32), np.zeros((16, width), bool)
        self.index: list[dict[bytes, list[int]]] = [{} for _ in self.runs]

    def place(self, name: int, tokens: np.ndarray) -> int:
        """The name of the template that the next line lies in: the one it agrees most with, the earlier in a tie, else one of its own."""
        keys = [tokens[a:b].tobytes() for a, b in self.runs]
        near = {t for known, k in zip(self.index, keys, strict=True) for t in known.get(k, ())}
        if near:
            at = np.fromiter(sorted(near), np.int64, len(near))
            agree = ((self.table[at] == tokens) & ~self.fields[at]).sum(1)
            best = int(agree.argmax())
            if agree[best] >= self.need:
                t = int(at[best])
                self.fields[t] |= self.table[t] != tokens
                return self.names[t]
        t = len(self.names)
        if t == len(self.table):
            self.table, self.fields = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.fields, np.zeros_like(self.fields)])
        self.table[t] = tokens
        self.names.append(name)
        for known, k in zip(self.index, keys, strict=True):
            known.setdefault(k, []).append(t)
        return name


def _runs(width: int, alike: float, same: int) -> list[tuple[int, int]]:
    """The places from `same` on, in one run more than places may differ; an empty run where there are too few, which all lines have in common."""
    spare = width - math.ceil(alike * width - 1e-9)
    free = max(0, width - same)
    cuts = [same + round(free * i / (spare + 1)) for i in range(spare + 2)]
    return list(zip(cuts, cuts[1:], strict=False)) if free else [(0, 0)]


def _sightings(depth: int):
    """(path, line, k): the keys of each text's units, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in chunks(utf8(b.column(1))):
                u = Units(texts, depth)
                rows = np.unique(np.stack([u.doc[u.counted], u.path[u.counted], u.name[u.counted]]), axis=1)
                if rows.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[2]), b.column(0).take(pa.array(rows[0] + at))], names=["path", "line", "k"])

    return run


def _tokens(depth: int, bits: np.ndarray):
    """(path, line, tokens) of the units whose path may be in the map of bits; some come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a unit's place is its name's low bits, where a later one takes over; at first each place holds a name that belongs elsewhere
        names = np.arange(REMEMBERED) ^ 1
        paths = np.zeros(REMEMBERED, np.int64)
        for b in batches:
            for _, texts in chunks(utf8(b.column(0))):
                u = Units(texts, depth)
                bit = u.path % (len(bits) * 8)
                own = np.flatnonzero(u.counted & (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0))
                own = own[np.unique(np.stack([u.path[own], u.name[own]]), axis=1, return_index=True)[1]]
                place = u.name[own] & (REMEMBERED - 1)
                new = (names[place] != u.name[own]) | (paths[place] != u.path[own])
                own, place = own[new], place[new]
                if len(own):
                    names[place], paths[place] = u.name[own], u.path[own]
                    size = u.last[own] - u.first[own]
                    ends = np.cumsum(size)
                    words = u.words[np.repeat(u.first[own] - (ends - size), size) + np.arange(ends[-1])].astype(np.uint32)
                    offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                    tokens = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
                    yield pa.RecordBatch.from_arrays([pa.array(u.path[own]), pa.array(u.name[own]), tokens], names=["path", "line", "tokens"])

    return run


def path_map(paths: DataFrame) -> np.ndarray:
    """A map with the bit path mod size set for each path: about 16 bits a path, of 2 ** MAP_BITS bits at most."""
    size = 1 << min(MAP_BITS, max(16, (16 * paths.count()).bit_length()))
    x = F.pmod("path", F.lit(size)) + 1
    parts = paths.groupBy(F.bitmap_bucket_number(x).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    out = np.zeros(max(size, 1 << 15) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out[: size // 8]


def _leaves(depth: int, alike: float):
    """(path, line, template) of the lines that lie in another one's template, from rows sorted by path, part and line.

    Rows stream through; what a task holds are the templates of one leaf, or of a part of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf, last = None, None, None
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for path, part, line, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if (path, part) != at:
                    at, leaf, last = (path, part), None, None
                if line == last:
                    continue
                last, words = line, np.frombuffer(tokens.as_py(), np.uint32)
                leaf = leaf or Leaf(len(words), alike, depth)
                if (t := leaf.place(line, words)) != line:
                    out.append((path, line, t))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["path", "line", "template"])

    return run


def _runs_of_lines(depth: int, alike: float):
    """(path, line, run): a hash of each of a line's runs of places, with the number of the run."""

    def make():
        def f(b: pa.RecordBatch):
            cols: list[list] = [[], [], []]
            for path, line, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = np.frombuffer(tokens.as_py(), np.uint32)
                for i, (x, y) in enumerate(_runs(len(words), alike, depth)):
                    cols[0].append(path)
                    cols[1].append(line)
                    cols[2].append(int(np.uint64(xxhash.xxh64_intdigest(words[x:y].tobytes(), i)).view(np.int64)))
            return cols

        return f

    return make


def _parts(tokens: DataFrame, hot: DataFrame, depth: int, alike: float) -> DataFrame:
    """(path, line, part) of the lines of hot leaves. Lines of different parts share no run, so they never meet in a template."""
    mine = written(tokens.join(hot, "path", "left_semi"), "line-hot")
    runs = written(per_batch(mine, _runs_of_lines(depth, alike), "path long, line long, run long").distinct(), "line-runs")
    node = F.xxhash64("path", "line")
    first = written(runs.groupBy("path", "run").agg(F.min(node).alias("b")), "line-first")
    links = runs.join(first, ["path", "run"]).select(node.alias("a"), "b")
    found = written(connected_components(links, name="line-parts"), "line-parts-found")
    own = runs.select("path", "line").distinct().withColumn("node", node)
    return written(own.join(found, "node", "left").select("path", "line", F.coalesce("component", "node").alias("part")), "line-parted")


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, alike: float = ALIKE, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """(key, lines): per document the keys of its lines that go, as (path, line) pairs. Rows that repeat a key are one document, rows without a key none.

    A leaf of more than hot_lines sightings is dealt out by parts whose lines can't meet in a
    template. The templates are the same; only the tasks they are found in differ.
    """
    known = docs.where(col(key).isNotNull()).select(col(key).alias("k"), col(text).alias("t"))
    kind = StructType([StructField("path", LongType()), StructField("line", LongType()), StructField("k", docs.schema[key].dataType)])
    every = written(in_arrow(known, _sightings(depth), kind), "lines-sighted")
    # most paths lie in one document alone: their units go no further. Each join below stands on plain exchanges or a broadcast.
    paths = written(every.groupBy("path").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("path"), "lines-paths")
    seen = written(every.join(paths, "path", "left_semi").distinct(), "lines-seen")
    # and leaves of one unit need no tokens
    shared = written(seen.groupBy("path").agg(F.min("line").alias("c"), F.max("line").alias("d"), F.count("*").alias("n")).where("c <> d").select("path", "n"), "lines-shared")
    discard(every, paths)
    bits = docs.sparkSession.sparkContext.broadcast(path_map(shared))  # 2 ** MAP_BITS bits at most
    tokens = in_arrow(docs.select(col(text)), lambda batches: _tokens(depth, bits.value)(batches), "path long, line long, tokens binary").join(shared.select("path"), "path", "left_semi")
    hot = shared.where(F.col("n") > hot_lines).select("path")
    if hot.take(1):
        tokens = written(tokens.dropDuplicates(["path", "line"]), "line-tokens")
        parts = _parts(tokens, written(hot, "line-hot-paths"), depth, alike)
        tokens = tokens.join(parts, ["path", "line"], "left").select("path", F.coalesce("part", F.lit(0)).alias("part"), "line", "tokens")
    else:
        tokens = tokens.select("path", F.lit(0).cast("long").alias("part"), "line", "tokens")
    merged = tokens.repartition("path", "part").sortWithinPartitions("path", "part", "line").mapInArrow(_leaves(depth, alike), "path long, line long, template long")
    merged = written(merged, "line-templates")
    named = written(seen.join(merged, ["path", "line"], "left").withColumn("template", F.coalesce("template", "line")), "lines-named")
    recurring = named.groupBy("path", "template", "k").agg(F.lit(1).alias("one")).groupBy("path", "template").agg(F.count("*").alias("n"), F.min("k").alias("first")).where(F.col("n") >= min_docs)
    # as a table, so that the join stands on two plain exchanges, which AQE may split at a hot template
    recurring = written(recurring, "lines-recurring")
    going = named.join(recurring, ["path", "template"]).where(F.col("k") != F.col("first"))
    return going.groupBy(F.col("k").alias(key)).agg(F.collect_list(F.struct("path", "line")).alias("lines"))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, alike: float = ALIKE, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """docs with text shortened, all other columns as they were, and n_lines, n_dropped, n_cut at the end: lines with tokens, those that went whole, those that lost a part.

    Lines without tokens stay and count as none. Null texts stay null, empty ones empty. Rows
    without a key stay whole and make nothing recur; rows that repeat a key are one document. An
    empty table gives no rows. Columns of docs that are named n_lines, n_dropped or n_cut are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "n_cut")
    going = recurring_lines(docs, key, text, depth, alike, min_docs, hot_lines)
    free = "_lines"
    while free in docs.columns:
        free = f"_{free}"
    going = going.select(col(key).alias("_k"), F.col("lines").alias(free))
    both = docs.join(going, docs[quoted(key)] == going["_k"], "left").select(*[docs[quoted(c)] for c in docs.columns], going[free])
    schema = StructType(docs.schema.fields).add("n_lines", "long").add("n_dropped", "long").add("n_cut", "long")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in chunks(utf8(b.column(at))):
                # a few texts at a time, here and in what is returned: neither side holds a second batch
                part = b.slice(first, len(some))
                going = part.column(part.num_columns - 1)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(going), 0).to_numpy(zero_copy_only=False))))
                path, line = (pc.struct_field(pc.list_flatten(going), x).to_pylist() for x in ("path", "line"))
                u = Units(some, depth)
                n_lines = np.bincount(u.doc[np.concatenate(([True], (u.doc[1:] != u.doc[:-1]) | (u.line[1:] != u.line[:-1])))[: len(u.doc)]], minlength=len(some))
                texts, gone, short = [], [], []
                for i, t in enumerate(some):
                    drop = set(zip(path[ends[i] : ends[i + 1]], line[ends[i] : ends[i + 1]], strict=True))
                    new, n, m = shortened(t, u, u.of(i), drop) if drop else (None, 0, 0)
                    texts.append(new)
                    gone.append(n)
                    short.append(m)
                new = pa.array(texts, pa.binary()).cast(pa.string())
                old = part.column(at)
                cols = [*part.columns[:at], pc.if_else(new.is_null(), old, new.cast(old.type)), *part.columns[at + 1 : -1], *(pa.array(x, pa.int64()) for x in (n_lines, gone, short))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return in_arrow(both, run, schema)
