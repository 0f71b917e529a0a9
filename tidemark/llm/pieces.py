"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model file's pieces, log scores and character map are read as they are. Code points that no
piece covers become byte pieces; a user's own pieces win over other paths. Where no piece holds a white-space marker after other code points, the best
path never crosses a word's start, so paths are found word by word and kept for words seen before.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, in_arrow, tokenizer_bytes, with_key

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the least score of any piece: what an uncovered code point costs.
UNKNOWN_PENALTY = 10.0
#: Words whose paths a task keeps before it forgets them all and starts anew, and bytes of the longest of these.
REMEMBERED, WORD_BYTES = 500_000, 64


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Pieces:
    """What a model file says: pieces with scores and kinds, and how texts are prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False
    characters: bytes = b""


def read_model(raw: bytes) -> Pieces:
    m = Pieces([], [], [])
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append(f.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            m.kinds.append(f.get(3, NORMAL))
        elif number == 2:
            m.suffix = bool(dict(_fields(value)).get(24, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.dummy_prefix, m.squeeze, m.escape, m.characters = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1)), f.get(2, b"")
    return m


class CharacterMap:
    """A model's own normalisation: the longest key at a place becomes its replacement. Keys are in a double array of 32-bit units."""

    def __init__(self, raw: bytes) -> None:
        size = struct.unpack_from("<I", raw)[0] if raw else 0
        self.units = struct.unpack_from(f"<{size // 4}I", raw, 4) if raw else ()
        self.texts = raw[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def at(self, text: bytes, i: int) -> tuple[bytes, int]:
        """(replacement, end) of what begins at byte i: of the longest key, else the code point itself."""
        units, found = self.units, None
        if units:
            p, j = self._step(units[0]), i
            while j < len(text):
                p ^= text[j]
                if p >= len(units) or units[p] & 0x800000FF != text[j]:
                    break
                unit = units[p]
                p ^= self._step(unit)
                j += 1
                if unit >> 8 & 1:
                    found = units[p] & 0x7FFFFFFF, j
        if found:
            return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]
        b = text[i]
        end = i + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
        return text[i:end], end


class DoubleArray:
    """A trie in two arrays: from node p, byte b leads to base[p] + b + 1 if check there is p. value[p] is a piece's id or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, i in keys:
            p = 0
            for b in key:
                q = children[p].get(b)
                if q is None:
                    q = children[p][b] = len(children)
                    children.append({})
                    ids.append(-1)
                p = q
            ids[p] = i
        size = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        free, tail, queue = 1, 0, [(0, 0)]
        for old, new in queue:
            self.value[new] = ids[old]
            labels = sorted(children[old])
            if not labels:
                continue
            # single children fill gaps; the rest go on from where the last found room
            if len(labels) == 1:
                while free < len(taken) and (taken[free] or free <= labels[0]):
                    free += 1
                at = free - labels[0] - 1
            else:
                at = tail
                while any(at + b + 1 < len(taken) and taken[at + b + 1] for b in labels):
                    at += 1
                tail = at
            if (more := at + 258 - len(taken)) > 0:
                taken.extend(bytes(more + 4096))
                self.base += [0] * (more + 4096)
                self.check += [-1] * (more + 4096)
                self.value += [-1] * (more + 4096)
            self.base[new] = at
            for b in labels:
                taken[at + b + 1] = 1
                self.check[at + b + 1] = new
                queue.append((children[old][b], at + b + 1))


class Encoder:
    def __init__(self, model: Pieces) -> None:
        self.model = model
        usable = [(i, p) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER) and p]
        self.trie = DoubleArray([(p.encode(), i) for i, p in usable])
        self.scores = [float(s) for s in model.scores]
        self.np_base, self.np_check, self.np_value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        # the least of the ordinary pieces' scores
        self.unknown_score = min((self.scores[i] for i, p in usable if model.kinds[i] == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        self.bytes = [-1] * 256
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.fallback = min(self.bytes) >= 0
        # a user's own pieces are to win over other paths
        most = max((self.scores[i] for i, _ in usable if model.kinds[i] == NORMAL), default=0.0)
        own = {i: p for i, p in usable if model.kinds[i] == USER}
        for i, p in own.items():
            self.scores[i] = len(p.encode()) * most - 0.1
        self.np_scores = np.array(self.scores)
        self.whole = re.compile(b"|".join(re.escape(p.encode()) for p in sorted(own.values(), key=len, reverse=True))) if own else None
        self.characters = CharacterMap(model.characters) if model.characters or own else None
        self.space = MARK if model.escape else " "
        crossing = any(MARK in p.lstrip(MARK) or " " in p for _, p in usable) or not model.escape or model.suffix
        ends = any("\n" in p for _, p in usable)
        self.words = None if crossing else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if ends else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.paths: dict[str, tuple[int, ...]] = {}
        self.text = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    def prepared(self, text: str) -> str:
        """The text as the model's normaliser gives it, white space still as spaces."""
        if self.characters:
            text = self._mapped(text.encode("utf-8", "replace")).decode("utf-8", "replace")
        elif self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.model.dummy_prefix:
            return text + " " if self.model.suffix else " " + text
        return text

    def _mapped(self, text: bytes) -> bytes:
        """Replacements from left to right, a user's pieces left as they are; with spaces squeezed as they come out."""
        out, i, blank, squeeze = bytearray(), 0, True, self.model.squeeze
        while i < len(text):
            if self.whole and (m := self.whole.match(text, i)):
                new, i = m[0], m.end()
            else:
                new, i = self.characters.at(text, i)
            if squeeze:
                new = new.lstrip(b" ") if blank else new
                if new:
                    blank = new.endswith(b" ")
            out += new
        return bytes(out.rstrip(b" ")) if squeeze else bytes(out)

    def best_path(self, text: bytes) -> tuple[int, ...]:
        """Ids of the path with the largest sum of scores; in a tie the one found first, from the left and from short to long."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, low, size = len(text), self.unknown_score, len(self.trie.check)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            b = text[i]
            end = i + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            here, single, p, j = best[i], False, 0, i
            while j < n:
                q = base[p] + text[j] + 1
                if q >= size or check[q] != p:
                    break
                p = q
                j += 1
                if (v := value[p]) >= 0:
                    if (s := here + scores[v]) > best[j]:
                        best[j], back[j], piece[j] = s, i, v
                    single = single or j == end
            if not single and here + low > best[end]:
                best[end], back[end], piece[end] = here + low, i, -1
            i = end
        return self._traced(text, back, piece)

    def best_paths(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """best_path of each text, texts of equal length all at once: the same steps, a column of bytes at a time."""
        out: list[tuple[int, ...]] = [()] * len(texts)
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        for n, rows in by_length.items():
            if n > WORD_BYTES or len(rows) < 8:
                for i in rows:
                    out[i] = self.best_path(texts[i])
                continue
            x = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8).reshape(-1, n).astype(np.int32)
            m = len(rows)
            best = np.full((n + 1, m), -np.inf)
            back, piece = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
            best[0] = 0.0
            width = np.where(x < 0x80, 1, np.where(x < 0xE0, 2, np.where(x < 0xF0, 3, 4)))
            for i in range(n):
                live = np.flatnonzero((x[:, i] & 0xC0) != 0x80)
                if not len(live):
                    continue
                starts, ends = live, i + width[live, i]
                single = np.zeros(m, bool)
                p = np.zeros(len(live), np.int32)
                for j in range(i, n):
                    q = self.np_base[p] + x[live, j] + 1
                    ok = self.np_check[np.minimum(q, len(self.np_check) - 1)] == p
                    live, p, ends_here = live[ok], q[ok], ends[ok]
                    ends = ends_here
                    if not len(live):
                        break
                    v = self.np_value[p]
                    got = v >= 0
                    w, v = live[got], v[got]
                    single[w[ends[got] == j + 1]] = True
                    s = best[i, w] + self.np_scores[v]
                    better = s > best[j + 1, w]
                    w = w[better]
                    best[j + 1, w], back[j + 1, w], piece[j + 1, w] = s[better], i, v[better]
                bare = starts[~single[starts]]
                end = i + width[bare, i]
                s = best[i, bare] + self.unknown_score
                better = s > best[end, bare]
                bare, end = bare[better], end[better]
                best[end, bare], back[end, bare], piece[end, bare] = s[better], i, -1
            for i, prior, ids in zip(rows, back.T.tolist(), piece.T.tolist(), strict=True):
                out[i] = self._traced(texts[i], prior, ids)
        return out

    def _traced(self, text: bytes, back: list[int], piece: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        n = len(text)
        while n:
            i = back[n]
            if piece[n] >= 0:
                out.append(piece[n])
            elif self.fallback:
                out += [self.bytes[x] for x in reversed(text[i:n])]
            elif not out or out[-1] != self.unknown:  # neighbours are one unknown piece
                out.append(self.unknown)
            n = i
        return tuple(reversed(out))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if self.words is None:
            return [list(self.best_path(t.replace(" ", self.space).encode("utf-8", "replace"))) for t in map(self.prepared, texts)]
        paths, find = self.paths, self.words.findall
        if len(paths) >= REMEMBERED:
            paths.clear()
        each = [find(self.prepared(t).replace(" ", MARK)) for t in texts]  # a marker in the text is a space like any other
        new = list({w for words in each for w in words if w not in paths})
        own = dict(zip(new, self.best_paths([w.encode("utf-8", "replace") for w in new]), strict=True))
        long = {w for w in new if len(w) > WORD_BYTES}
        paths.update((w, p) for w, p in own.items() if w not in long)
        out = []
        for words in each:
            ids: list[int] = []
            for w in words:
                ids += paths[w] if w not in long else own[w]
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Pieces put together, markers as spaces, without the space that encoding set before (or after); bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        if self.model.dummy_prefix and self.model.suffix:
            return out.removesuffix(" ")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


_LOADED: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This process's encoder for a public model file or a path."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(read_model(tokenizer_bytes(name)))
    return _LOADED[name]


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, ids, n_tokens, n_byte_pieces, decoded_equal (decoding gives the text again).

    Null texts are empty ones, with no ids; keys may be null or repeated, each row stands for itself;
    an empty table gives no rows. Texts that hold the marker itself decode to a space there, and a
    model that squeezes spaces or maps characters decodes to what it prepared: decoded_equal is
    false. A text is taken whole; a word of more than WORD_BYTES is not remembered, and a text
    without spaces is one word, with memory in proportion to it.
    """

    def run(batches):
        e = encoder(model)
        byte_ids = np.zeros(len(e.text), bool)
        byte_ids[[i for i in e.bytes if i >= 0]] = True
        names = [key, "ids", "n_tokens", "n_byte_pieces", "decoded_equal"]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows, fallback, equal = [], [], []
                texts = part.column(1).to_pylist()
                for x, ids in zip(texts, e.encode_batch(texts), strict=True):
                    equal.append(e.decode(ids) == x)
                    rows.append(np.array(ids, np.int32))
                    fallback.append(int(byte_ids[rows[-1]].sum()))
                lengths = np.array([len(r) for r in rows], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(lengths), pa.array(fallback, pa.int64()), pa.array(equal, pa.bool_())], names=names)

    return in_arrow(docs.select(col(key), F.coalesce(col(text), F.lit("")).alias("t")), run, with_key(docs, key, "ids array<int>, n_tokens long, n_byte_pieces long, decoded_equal boolean"))
