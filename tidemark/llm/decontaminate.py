"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words of digits, a-z and everything beyond ASCII, with single spaces
around each. The automaton holds every window of the items; a text is scanned once, and each
match is carried back to word numbers and to places in the original text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, in_arrow, per_batch, utf8, with_key
from tidemark.session import discard, written

#: Bytes of item text in one automaton; more items make more blocks, each scanned in its turn.
BLOCK_BYTES = 8_000_000
WINDOW = 10
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """All runs of size words; a shorter item is one window, an item of no words none."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str, bytes]], size: int = WINDOW):
    """items: (id, UTF-8 text). Each pattern's value is its number of words and the ids that have it."""
    import ahocorasick

    holders: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows(words_of(text), size):
            holders[w].add(item)
    a = ahocorasick.Automaton()
    for w, ids in holders.items():
        a.add_word(f" {w.decode('utf-8', 'surrogateescape')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    a.make_automaton()
    return a


def scan(a, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words; merged (first, end) word ranges inside windows; ids of the items found."""
    words = words_of(text)
    if not words or not len(a):
        return len(words), [], set()
    hay = f" {b' '.join(words).decode('utf-8', 'surrogateescape')} "
    found, ids, spaces = [], set(), None
    for end, (n, who) in a.iter(hay):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        last = int(np.searchsorted(spaces, end))  # the space after word number last-1
        found.append((last - n, last))
        ids.update(who)
    return len(words), merged(found), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point spans of the original text, from the first word's start to the last one's end."""
    points = np.frombuffer(text, np.uint8)
    keep = np.frombuffer(text.translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    before = np.concatenate(([0], np.cumsum((points & 0xC0) != 0x80)))
    return [(int(before[starts[s]]), int(before[ends[e - 1]])) for s, e in ranges]


def item_blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    total = items.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    n = int(total // block_bytes) + 1
    return [items.where(F.pmod(F.xxhash64(col(item), col(text)), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def contaminated_words(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, word_spans, char_spans.

    Null or wordless texts and items hit nothing; null item ids count as the empty string; repeated
    items and documents are handled as they stand; no items or no documents give no hits or rows.
    One automaton is broadcast for at most block_bytes of item text. Items beyond that make further
    blocks: each is a scan of its own over the table that the block before it wrote, after which its
    broadcast is gone.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(col(key).alias("k"), col(text).alias("t"), F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("ids"))
    blocks = item_blocks(items, item, item_text, block_bytes)
    for i, block in enumerate(blocks):
        rows = [(str(r[0]) if r[0] is not None else "", (r[1] or "").encode("utf-8", "surrogatepass")) for r in block.select(col(item), col(item_text)).toLocalIterator()]
        shared = sc.broadcast(rows)
        if i + 1 < len(blocks):
            now = written(per_batch(out, _block(shared, size, False), out.schema), "decontaminate-block")
            shared.unpersist(True)
            discard(out)
            out = now
    return per_batch(out, _block(shared, size, True), with_key(docs, key, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, word_spans array<array<int>>, char_spans array<array<int>>"))


def _block(shared, size: int, last: bool):
    def make():
        a = automaton(shared.value, size)

        def f(b: pa.RecordBatch):
            earlier = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)
            cols: list[list] = [[] for _ in range(8 if last else 4)]
            for t, (s, e, ids) in zip(utf8(b.column(1)), earlier, strict=True):
                n, ranges, found = scan(a, t)
                if s:
                    ranges = merged([*ranges, *zip(s, e, strict=True)])
                found.update(ids)
                who = sorted(found)
                if last:
                    hit = sum(y - x for x, y in ranges)
                    row = (n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), hit > 0, who, ranges, original_spans(t, ranges) if ranges else [])
                else:
                    row = (n, [x for x, _ in ranges], [y for _, y in ranges], who)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return [b.column(0), *([] if last else [b.column(1)]), *cols]

        return f

    return make


def keep_uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no window of an item occurs, all columns as they were.

    Null and wordless texts stay, repeated rows each stand for themselves. Blocks of items run one
    after the other over what is left.
    """
    sc = docs.sparkSession.sparkContext
    out, at, names = docs, docs.columns.index(text), docs.columns
    blocks = item_blocks(items, item, item_text, block_bytes)
    for i, block in enumerate(blocks):
        shared = sc.broadcast([("", (r[0] or "").encode("utf-8", "surrogatepass")) for r in block.select(col(item_text)).toLocalIterator()])

        def run(batches, shared=shared):
            a = automaton(shared.value, size)
            for b in batches:
                yield b.filter(pa.array([not scan(a, t)[1] for t in utf8(b.column(at))], pa.bool_())).rename_columns(names)

        now = in_arrow(out, run, docs.schema)
        if i + 1 < len(blocks):
            now = written(now, "decontaminate-block")
            shared.unpersist(True)
            discard(out)
        out = now
    return out
