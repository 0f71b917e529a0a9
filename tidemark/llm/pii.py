"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans, which always stay. The field labels every token: neighbours share
a chain potential, and occurrences of equal or similar tokens, however far apart in the document,
share a skip potential. A token in a base span has that label for certain; loopy message passing
carries it to the other mentions, whose own form leaves them open. Tokens that no message of their
neighbours could lift to a belief that counts are o from the start.

Potentials are fitted by pseudo-likelihood on a bounded sample. Its labels are the base spans, a
part of which is obscured or mentioned again with an end cut off (see `examples`), so that form,
context and other mentions have to supply what the patterns don't see.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, per_batch, with_key

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
#: Documents that the potentials are fitted on, about, and tokens of these at most.
FIT_ROWS, FIT_TOKENS = 6000, 24_000
#: Belief above which a token outside the base spans becomes a span.
BELIEF = 0.8
#: Rounds after which messages that still move are taken as they are.
ROUNDS = 200
SIZE = 1 << 14
#: Distinct words that a task remembers before it forgets them all, and words that it labels at once.
REMEMBERED, AT_ONCE = 200_000, 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W0-9_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_AT = re.compile(r"@|[\[(]at[\])]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), sorted. Linear in the text: no pattern is tried again inside a long run."""
    out: list[Span] = []
    if not _MARK.search(text):
        return out
    last = 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, 0, m.end()))
            last = m.end()
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@dataclass
class Field:
    """Potentials of the labels: of hashed features, of neighbours, of equal or similar tokens."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


class Words:
    """What is known of each distinct word: its feature ids as itself, as a left and as a right neighbour, and its skip keys."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.own: list[list[int]] = []
        self.beside: list[tuple[int, int]] = []
        self.keys: list[tuple[int, ...]] = []
        self.add("")  # what stands before the first word and after the last

    def add(self, w: str) -> int:
        i = self.number[w] = len(self.own)
        own, left, right = word_features(w)
        self.own.append(own)
        self.beside.append((left, right))
        self.keys.append(skip_keys(w))
        return i

    def numbers(self, words: list[str]) -> list[int]:
        get, add = self.number.get, self.add
        return [i if (i := get(w)) is not None else add(w) for w in words]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def hash_wide(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def coarse(word: str) -> str:
    """Runs of digits as d, of letters as a, other code points as they are, of the whole token."""
    return _DIGITS.sub("d", _LETTERS.sub("a", word))


def fine(word: str) -> str:
    """As coarse, with the length of each run of digits."""
    return _DIGITS.sub(lambda m: f"<{min(len(m[0]), 24)}>", _LETTERS.sub("a", word))


def word_features(w: str) -> tuple[list[int], int, int]:
    """Ids of what a token says itself, and of what it says as a left and as a right neighbour."""
    if w.isalpha():  # most words, in short
        plain = w.lower() if len(w) <= 12 else "a"
        return [*_PLAIN, _hash(f"word {plain}") % SIZE], _hash(f"left {plain}") % SIZE, _hash(f"right {plain}") % SIZE
    digits = _NOT_DIGIT.sub("", w)
    form = coarse(w)
    plain = w.lower() if len(w) <= 12 and not digits else form
    return [*_form_features(w, form, digits), _hash(f"word {plain}") % SIZE], _hash(f"left {plain}") % SIZE, _hash(f"right {plain}") % SIZE


def _form_features(w: str, form: str, digits: str) -> list[int]:
    names = ("bias", f"coarse {form}", f"fine {fine(w)}", f"digits {min(len(digits), 20)}", f"signs {'@' in w} {min(w.count('.'), 6)} {min(w.count('-'), 4)} {w[:1] == '+'}", f"luhn {14 <= len(digits) <= 19 and luhn(digits)}")
    return [_hash(n) % SIZE for n in names]


_PLAIN = _form_features("a", "a", "")


def skip_keys(w: str) -> tuple[int, ...]:
    """What equal and similar tokens have in common; tokens without a digit or an at sign have nothing.

    The token in lower case without the punctuation around it, what stands before its at sign, and
    the first and the last six of its digits.
    """
    if not _MARK.search(w):
        return ()
    plain = _EDGES.sub("", w.lower())
    out = {f"w {plain}", f"w {_EDGES.sub('', _AT.split(plain)[0])}"}
    digits = _NOT_DIGIT.sub("", w)
    if len(digits) >= 6 and "@" not in w:
        out |= {f"p {digits[:6]}", f"s {digits[-6:]}"}
    return tuple(sorted(hash_wide(k) for k in out if len(k) > 4))


def skip_edges(keys: list[tuple[int, ...]], at: list[int]) -> list[tuple[int, int]]:
    """Pairs of places in `at`: each occurrence of a key with the one before and with the first. At most two edges for each key of a token."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    out = set()
    for i, own in zip(at, keys, strict=True):
        for k in own:
            if k in first:
                out |= {(first[k], i), (last[k], i)}
            else:
                first[k] = i
            last[k] = i
    return sorted(out)


def base_labels(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """A token's label: one more than the kind of the first base span that overlaps it, or 0."""
    out, j, open_ = [], 0, []
    for s, e in places:
        while j < len(spans) and spans[j][0] < e:
            open_.append(spans[j])
            j += 1
        open_ = [x for x in open_ if x[2] > s]
        out.append(min(open_)[1] + 1 if open_ else 0)
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Where the tokens of text.split() stand."""
    return [m.span() for m in _TOKEN.finditer(text)]


# --- examples to fit on


def obscured(kind: int, said: str) -> list[str]:
    """A mention that no pattern matches and that its form still gives away."""
    if kind == 0:
        local, _, host = said.partition("@")
        forms = [f"{local}[at]{host.replace('.', '[dot]')}"], [f"{local}[at]{host}"], [local, "(at)", host], [local, "(at)", *host.replace(".", " (dot) ").split()]
        return forms[len(said) % 4]
    if kind == 1:
        return [said.replace(".", "[.]")]
    if kind == 2:
        digits = _NOT_DIGIT.sub("", said)
        return ["/".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return ["/".join(_DIGITS.findall(said)).join(("+", ""))]


def clipped(kind: int, said: str, odd: bool) -> list[str]:
    """A mention with an end cut off: a token of its own that only a whole mention elsewhere explains."""
    if kind == 0:
        local, _, host = said.partition("@")
        return [local] if odd else [f"{local}@{host.split('.')[0]}"]
    if kind == 1:
        return [said.rpartition(".")[0]]
    digits = _NOT_DIGIT.sub("", said)
    if kind == 2:
        return [digits[: len(digits) - 4]] if odd else [digits[:6]]
    return [f"{digits[-7:-4]}-{digits[-4:]}"] if odd else [digits[-7:]]


def strangers(said: list[str], rng: np.random.Generator) -> list[str]:
    """The same form with other digits and letters."""
    swap = lambda c: chr(48 + int(rng.integers(10))) if "0" <= c <= "9" else chr(97 + int(rng.integers(26))) if c.isalpha() else c
    return ["".join(map(swap, w)) for w in said]


def examples(text: str, seed: int, around: int = 3) -> tuple[list[str], list[int], list[bool]]:
    """(words, labels, follows): what a text gives to fit on, from the surroundings of its digits and signs.

    Labels are those of the base spans. Three quarters of the spans get a second mention that is
    clipped, and a quarter is replaced by an obscured one; both keep the label, so that context, form
    and the other mention must supply it. As many clipped mentions of nobody are o. follows[i]
    tells whether word i stands right after word i-1.
    """
    rng = np.random.default_rng(seed & ((1 << 63) - 1))
    base, at, words = base_spans(text), places(text), text.split()
    labels = base_labels(at, base)
    put: list[tuple[int, int, list[str], int]] = []  # from, to, words in place of these, label
    used = np.array(labels) > 0
    starts, ends = [a for a, _ in at], [b for _, b in at]
    for s, k, e in base:
        own = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e))
        draw, odd = rng.random(), bool(rng.integers(2))
        if draw < 0.25:
            put.append((*own, obscured(k, text[s:e]), k + 1))
        else:
            put.append((p := _gap(used, rng), p, clipped(k, text[s:e], odd), k + 1))
        if rng.random() < 0.75:
            put.append((p := _gap(used, rng), p, strangers(clipped(k, text[s:e], odd), rng), 0))
    out: list[tuple[str, int, bool]] = []
    done = 0
    for a, b, new, label in sorted(put, key=lambda x: x[:2]):
        if a < done:
            continue
        out += [(w, y, False) for w, y in zip(words[done:a], labels[done:a], strict=True)]
        out += [(w, label, True) for w in new]
        done = b
    out += [(w, y, False) for w, y in zip(words[done:], labels[done:], strict=True)]
    marked = np.array([y > 0 or new or bool(_MARK.search(w)) for w, y, new in out], bool)
    some = np.flatnonzero(marked)
    if len(out):
        some = np.append(some, rng.integers(len(out)))  # one stretch of ordinary words
    keep = np.zeros(len(out) + 2 * around + 1, bool)
    for d in range(2 * around + 1):
        keep[some + d] = True
    kept = np.flatnonzero(keep[around : around + len(out)])
    return [out[i][0] for i in kept], [out[i][1] for i in kept], [bool(j) and kept[j] == kept[j - 1] + 1 for j in range(len(kept))]


def _gap(used: np.ndarray, rng: np.random.Generator) -> int:
    """A place to put words that doesn't part a labelled run."""
    for _ in range(20):
        p = int(rng.integers(len(used) + 1))
        if p in (0, len(used)) or not (used[p - 1] and used[p]):
            return p
    return len(used)


def graph(words: list[str], follows: list[bool], memo: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of each word, chain edges and skip edges."""
    ids = memo.numbers(words)
    rows = np.zeros((len(words), len(memo.own[0]) + 2), np.int32)
    for i, w in enumerate(ids):
        left = ids[i - 1] if follows[i] else 0
        right = ids[i + 1] if i + 1 < len(ids) and follows[i + 1] else 0
        rows[i] = [*memo.own[w], memo.beside[left][0], memo.beside[right][1]]
    return rows, _stack([(i - 1, i) for i, f in enumerate(follows) if f]), _stack(skip_edges([memo.keys[i] for i in ids], list(range(len(ids)))))


def _stack(edges: list[tuple[int, int]]) -> np.ndarray:
    return np.array(edges, np.int64).reshape(-1, 2)


def fit(rows: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 200, l2: float = 0.005) -> Field:
    """Pseudo-likelihood: each label given its features and its neighbours' labels. Edges are pairs of row numbers."""
    n, k = len(labels), len(LABELS)
    f = Field(np.zeros((SIZE, k)), np.zeros((k, k)), np.zeros((k, k)))
    if not n:
        f.node[_hash("bias") % SIZE, 0] = 12.0
        return f
    goal = np.eye(k)[labels]
    used, at = np.unique(rows, return_inverse=True)
    at = at.reshape(rows.shape)
    node = np.zeros((len(used), k))
    past = [np.full_like(x, 1e-2) for x in (node, f.chain, f.skip)]
    for _ in range(steps):
        z = node[at].sum(1)
        for edges, m in ((chain, f.chain), (skip, f.skip)):
            np.add.at(z, edges[:, 1], m[labels[edges[:, 0]]])
            np.add.at(z, edges[:, 0], m.T[labels[edges[:, 1]]])
        p = np.exp(z - z.max(1, keepdims=True))
        d = p / p.sum(1, keepdims=True) - goal
        g = l2 * node
        for c in range(k):
            g[:, c] += np.bincount(at.ravel(), np.repeat(d[:, c], rows.shape[1]), len(used))
        grads = [g]
        for edges, m in ((chain, f.chain), (skip, f.skip)):
            a, b = edges[:, 0], edges[:, 1]
            grads.append(goal[a].T @ d[b] + d[a].T @ goal[b] + l2 * m)
        for x, g, s in zip((node, f.chain, f.skip), grads, past, strict=True):
            s += g * g
            x -= 0.5 * g / np.sqrt(s)
    f.node[used] = node
    return f


# --- labels of whole texts


def beliefs(unary: np.ndarray, edges: np.ndarray, forms: np.ndarray, kind: np.ndarray, rounds: int = ROUNDS, close: float = 1e-3) -> np.ndarray:
    """Loopy sum-product, damped, until no message moves by more than `close` (or for `rounds` rounds); label shares of each row.

    forms[kind[e]] is edge e's potential, from the label of its first end to that of its second.
    """
    b, n, k = unary.copy(), len(edges), unary.shape[1]
    if n:
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([forms[kind], forms[kind].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        m = np.zeros((2 * n, k))
        for _ in range(rounds):
            b = unary.copy()
            np.add.at(b, dst, m)
            out = (b[src] - m[back])[:, :, None] + pair
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
            moved, m = np.abs(new - m).max(), new
            if moved < close:
                break
        b = unary.copy()
        np.add.at(b, dst, m)
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Labeller:
    """Texts to spans, many at a time: what words have in common is worked out once."""

    def __init__(self, f: Field, belief: float = BELIEF, skips: bool = True) -> None:
        self.field, self.belief, self.skips = f, belief, skips
        self.memo = Words()
        # the most that both neighbours together can add to a label's odds against o
        gain = (f.chain - f.chain[:, :1]).max(0) + (f.chain.T - f.chain[:1].T).max(0)
        self.open = np.log(belief / (1 - belief)) - gain[1:]
        self.forms = np.stack([f.chain, f.skip])
        self._tables()

    def _tables(self) -> None:
        self.known, self.size = 0, 1024
        k = len(LABELS)
        self.own, self.left, self.right = (np.zeros((self.size, k)) for _ in range(3))
        self.keyed = np.zeros(self.size, bool)

    def _grow(self) -> None:
        n, memo, node = len(self.memo.own), self.memo, self.field.node
        if n > self.size:
            more = max(n, 2 * self.size) - self.size
            self.own, self.left, self.right = (np.concatenate([x, np.zeros((more, x.shape[1]))]) for x in (self.own, self.left, self.right))
            self.keyed, self.size = np.concatenate([self.keyed, np.zeros(more, bool)]), self.size + more
        if n > self.known:
            new = slice(self.known, n)
            self.own[new] = node[np.array(memo.own[new])].sum(1)
            beside = np.array(memo.beside[new])
            self.left[new], self.right[new] = node[beside[:, 0]], node[beside[:, 1]]
            self.keyed[new] = [bool(x) for x in memo.keys[new]]
            self.known = n

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, base and added spans) of each text."""
        if len(self.memo.own) > REMEMBERED:
            self.memo.clear()
            self._tables()
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        # a word that is none stands between texts
        ids = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int64)
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(texts)), sizes) + 1
        flat: list[int] = []
        for w in words:
            flat += self.memo.numbers(w)
        ids[at] = flat
        self._grow()
        w = ids[at]
        unary = self.own[w] + self.left[ids[at - 1]] + self.right[ids[at + 1]]
        alive = self.keyed[w] | ((unary[:, 1:] - unary[:, :1]) >= self.open).any(1)
        base = [base_spans(t) for t in texts]
        where: dict[int, list[tuple[int, int]]] = {}
        fixed = np.full(len(w), -1)
        for i, b in enumerate(base):
            if b:
                where[i] = places(texts[i])
                y = np.array(base_labels(where[i], b))
                fixed[starts[i] : starts[i + 1]] = np.where(y > 0, y, -1)
        sure, kinds = self._sure(w, unary, alive, fixed, starts)
        cuts = np.searchsorted(sure, starts)
        out = []
        for i, b in enumerate(base):
            found: list[Span] = []
            if cuts[i] < cuts[i + 1]:
                mine = slice(cuts[i], cuts[i + 1])
                found = added_spans(texts[i], where.get(i) or places(texts[i]), sure[mine] - starts[i], kinds[mine])
            out.append((b, sorted([*b, *found])))
        return out

    def _sure(self, w: np.ndarray, unary: np.ndarray, alive: np.ndarray, fixed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in w, ascending, and kinds of the free tokens in which the belief in a kind is high."""
        free = alive & (fixed < 0)
        if not free.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chain, skip = self.field.chain, self.field.skip
        # a token that no message can make anything but o is o to its neighbours
        label = np.where(fixed >= 0, fixed, np.where(free, -1, 0))
        at = np.flatnonzero(free)
        u = unary[at].copy()
        inner = np.ones(len(w) + 1, bool)
        inner[starts] = False  # no chain across the ends of a text
        left, right = inner[at], inner[at + 1]
        known = left & (label[at - 1] >= 0)
        u[known] += chain[label[at - 1][known]]
        after = np.append(label, -1)[at + 1]
        known = right & (after >= 0)
        u[known] += chain.T[after[known]]
        row = np.full(len(w) + 1, -1)
        row[at] = np.arange(len(at))
        both = left & (row[at - 1] >= 0)
        edges, kinds = [np.stack([row[at - 1][both], np.flatnonzero(both)], 1)], [np.zeros(int(both.sum()), np.int64)]
        if self.skips:
            linked = np.flatnonzero(self.keyed[w] & (alive | (fixed >= 0)))
            text = np.searchsorted(starts, linked, "right")
            keys = [tuple((int(t), k) for k in self.memo.keys[w[j]]) for t, j in zip(text, linked, strict=True)]
            pairs = _stack(skip_edges(keys, linked.tolist()))
            a, b = pairs[:, 0], pairs[:, 1]
            la, lb, ra, rb = label[a], label[b], row[a], row[b]
            only = (rb >= 0) & (la >= 0)
            np.add.at(u, rb[only], skip[la[only]])
            only = (ra >= 0) & (lb >= 0)
            np.add.at(u, ra[only], skip.T[lb[only]])
            only = (ra >= 0) & (rb >= 0)
            edges.append(np.stack([ra[only], rb[only]], 1))
            kinds.append(np.ones(int(only.sum()), np.int64))
        share = beliefs(u, np.concatenate(edges), self.forms, np.concatenate(kinds))
        best = share.argmax(1)
        sure = (best > 0) & (share[np.arange(len(at)), best] >= self.belief)
        return at[sure], best[sure] - 1


def added_spans(text: str, spots: list[tuple[int, int]], sure: np.ndarray, kinds: np.ndarray) -> list[Span]:
    """The tokens that the field is sure of, without the punctuation around them; neighbours of one kind are one span."""
    out: list[Span] = []
    before = -2
    for j, k in zip(sure.tolist(), kinds.tolist(), strict=True):
        s, e = spots[j]
        while s < e and not (text[s].isalnum() or text[s] == "+"):
            s += 1
        while s < e and not text[e - 1].isalnum():
            e -= 1
        if s < e:
            if out and before == j - 1 and out[-1][1] == k:
                out[-1] = (out[-1][0], k, e)
            else:
                out.append((s, k, e))
            before = j
    return out


def fit_field(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, fit_tokens: int = FIT_TOKENS) -> Field:
    """Fitted on about fit_rows rows with a digit or an at sign, chosen by a hash of the key, and on fit_tokens of their tokens at most, in the order of that hash.

    Null texts are empty; a table without any text, or whose texts give no tokens, gives a field that labels nothing.
    """
    some = docs.where(col(text).rlike("[0-9@]")).select(F.xxhash64(col(key), F.lit("fit")).alias("h"), col(text).alias("t"))
    n = some.count()
    if n > fit_rows:
        some = some.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))

    def make():
        memo = Words()

        def f(b: pa.RecordBatch):
            cols: list[list] = [[], [], [], [], []]
            for h, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, labels, follows = (x[:fit_tokens] for x in examples(text.as_py(), h))
                if words:
                    if len(memo.own) > REMEMBERED:
                        memo.clear()
                    rows, chain, skip = graph(words, follows, memo)
                    for c, v in zip(cols, (h, rows.tobytes(), bytes(labels), chain.tobytes(), skip.tobytes()), strict=True):
                        c.append(v)
            return cols if cols[0] else None

        return f

    rows, labels, chain, skip, at = [], [], [], [], 0
    for r in per_batch(some, make, "h long, rows binary, labels binary, chain binary, skip binary").orderBy("h", F.xxhash64("rows", "labels")).toLocalIterator():
        y = np.frombuffer(bytes(r.labels), np.uint8).astype(np.int64)
        y, whole = y[: fit_tokens - at], len(y)
        rows.append(np.frombuffer(bytes(r.rows), np.int32).reshape(whole, -1)[: len(y)])
        labels.append(y)
        for out, raw in ((chain, r.chain), (skip, r.skip)):
            edges = np.frombuffer(bytes(raw), np.int64).reshape(-1, 2)
            out.append(edges[(edges < len(y)).all(1)] + at)
        at += len(y)
        if at >= fit_tokens:
            break
    none = np.zeros((0, 2), np.int64)
    if not at:
        return fit(np.zeros((0, 1), np.int32), np.zeros(0, np.int64), none, none)
    return fit(np.concatenate(rows), np.concatenate(labels), np.concatenate([none, *chain]), np.concatenate([none, *skip]))


def personal_data(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", belief: float = BELIEF, skips: bool = True) -> DataFrame:
    """One row per row of docs: key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans; spans has these and the added ones, kind:start:end in
    code points, end exclusive. Null and empty texts have none; keys may be null or repeated, each
    row stands for itself; an empty table gives no rows. A text is always taken whole: a very long
    one is labelled alone, with memory in proportion to its words. skips=False leaves the skip
    edges out, to show what they decide.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # SIZE x labels floats

    def make():
        labeller = Labeller(shared.value, belief, skips)

        def g(b: pa.RecordBatch):
            rows, held, size = [], [], 0
            for x in b.column(1):
                held.append(x.as_py())
                size += len(held[-1])
                if size > 6 * AT_ONCE:
                    rows += labeller.spans(held)
                    held, size = [], 0
            rows += labeller.spans(held)
            counts = [Counter(k for _, k, _ in base) for base, _ in rows]
            return [b.column(0), *([c[k] for c in counts] for k in range(4)), [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], [joined(spans) for _, spans in rows]]

        return g

    return per_batch(docs.select(col(key), F.coalesce(col(text), F.lit("")).alias("t")), make, with_key(docs, key, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
