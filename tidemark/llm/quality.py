"""Quality classifier: naive Bayes support vectors.

A text is the set of its byte n-grams, hashed, and of the n-grams of repetition: each word is
the one before it or isn't, and a run of n repeats is the n-gram of the former. Indicators are scaled
by the log ratio of their smoothed counts in the two classes, texts are brought to unit length, and
a linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of the labelled
rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, in_arrow, per_batch, utf8, with_key

BITS = 17
ORDERS = (1, 2, 3, 4)
#: Runs of repeated words that are told apart, by ids of their own above the hashed ones.
REPEATS = 8
SIZE = (1 << BITS) + REPEATS
#: Labelled rows that the model is fitted on, about; more are thinned by a hash of the key. Indicators of all these rows that the driver holds at most.
FIT_ROWS, FIT_IDS = 6000, 40_000_000
#: Of these, the share kept from the fit to set the scale of the scores.
CALIBRATION = 0.2
#: Bytes hashed at a time, so that a very long text needs no more memory.
CHUNK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(text: bytes, flags: np.ndarray | None = None, repeats: int = REPEATS) -> np.ndarray:
    """Sorted ids of the n-grams that occur in the whole text; an empty one has none."""
    flags = np.zeros(SIZE, bool) if flags is None else flags
    longest = max(ORDERS)
    for at in range(0, len(text), CHUNK):
        b = np.frombuffer(text, np.uint8, min(CHUNK + longest - 1, len(text) - at), at).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(1, longest + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + (b[n - 1 :] + np.uint32(1)) * _MULTIPLIERS[n - 1]
            if n in ORDERS:
                flags[(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)] = True
    words = text.split()
    again = bytes(map(eq, words, words[1:]))
    flags[1 << BITS : (1 << BITS) + min(repeats, max(map(len, again.split(b"\0"))))] = True
    ids = np.flatnonzero(flags)
    flags[ids] = False
    return ids.astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), margin = weights over the text's length-one vector."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        x = self.ratio[ids].astype(np.float64)
        return float(x @ self.weights[ids]) / max(float(np.sqrt(x @ x)), 1e-9) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = (smooth + sum((np.bincount(r, minlength=SIZE) for r, t in zip(rows, y, strict=True) if (t > 0) == side), np.zeros(SIZE)) for side in (True, False))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 20) -> tuple[np.ndarray, float]:
    """The hinge-loss model of least norm: one dual variable at a time, in a shuffled order that a fixed seed sets."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            g = y[i] * (w[ids] @ v + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[ids] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 4.0) -> Model:
    """labels: 0 or 1. Without rows of both classes every score is the smoothed share of label 1."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        share = (np.sum(y > 0) + 1) / (len(y) + 2)
        zero = np.zeros(SIZE, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % max(2, round(1 / CALIBRATION)) == 1
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    ratio = log_count_ratio([r for r, h in zip(rows, held, strict=True) if not h], y[~held])
    vectors = []
    for r in rows:
        v = ratio[r]
        vectors.append((r, v / max(float(np.sqrt(v @ v)), 1e-9)))
    w, bias = dual_descent([v for v, h in zip(vectors, held, strict=True) if not h], y[~held], np.full(int((~held).sum()), c), SIZE)
    m = Model(ratio.astype(np.float32), w.astype(np.float32), float(bias), 1.0, 0.0)
    use = held if held.any() else ~held
    m.slope, m.offset = _platt(np.array([m.margin(r) for r, u in zip(rows, use, strict=True) if u]), y[use] > 0)
    return m


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for a logistic curve over the margins, towards smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    t, a, b = np.where(y, hi, lo), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([d @ margins + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fold(key: str):
    """crc32 of the key as text, modulo 3; 1 marks the held-out rows."""
    return F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")) % 3


def thinned(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About so many rows of df at most, chosen by a hash of the key."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(col(key), F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * rows / n))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, fit_ids: int = FIT_IDS) -> Model:
    """A model of about fit_rows labelled rows at most, none of them held out, with fit_ids indicators in all at most.

    Rows without a label, with an unknown or a null key don't count; a key with several labels takes
    the least, and a key with several texts counts with each. Null texts are empty ones. Without
    rows of both classes every score is the smoothed share of label 1.
    """
    marked = labels.where(col(key).isNotNull() & col(label).isNotNull() & (fold(key) != 1)).groupBy(col(key).alias("k")).agg(F.min(col(label)).alias("y"))
    chosen = thinned(marked, "k", fit_rows)
    # fit_rows bounds what is broadcast
    rows = docs.where(col(key).isNotNull() & (fold(key) != 1)).select(col(key).alias("k"), col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "t", "y")

    def make():
        flags = np.zeros(SIZE, bool)
        return lambda b: [b.column(0).cast(pa.string()), b.column(2), [features(t, flags).tobytes() for t in utf8(b.column(1))]]

    got, size = [], 0
    for r in per_batch(rows, make, "k string, y int, ids binary").orderBy(F.xxhash64("k"), "k", F.xxhash64("ids")).toLocalIterator():
        ids = np.frombuffer(bytes(r.ids), np.int32)
        if (size := size + len(ids)) > fit_ids:
            break
        got.append((r.y, ids))
    return fit([ids for _, ids in got], np.array([y for y, _ in got]))


def quality_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted (score >= 0.5).

    Null texts score as empty ones, texts of any length whole. Keys may be null (folded as the empty
    string) or repeated, each row stands for itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of SIZE floats, whatever the data

    def make():
        m, flags = shared.value, np.zeros(SIZE, bool)

        def f(b: pa.RecordBatch):
            scores = [m.score(features(t, flags)) for t in utf8(b.column(2))]
            return [b.column(0), b.column(1), scores, [int(s >= 0.5) for s in scores]]

        return f

    return per_batch(docs.select(col(key), (fold(key) == 1).alias("held_out"), col(text)), make, with_key(docs, key, "held_out boolean, score double, predicted int"))


def keep_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they were; null texts are judged as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        m, flags = shared.value, np.zeros(SIZE, bool)
        for b in batches:
            yield b.filter(pa.array([m.score(features(t, flags)) >= 0.5 for t in utf8(b.column(at))], pa.bool_())).rename_columns(names)

    return in_arrow(docs, run, docs.schema)
