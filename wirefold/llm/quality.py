"""Quality classifier: Naive Bayes features for a support vector machine.

Features are indicators of n-grams of words (1 to 2) and of n-grams (1 to 3 words) over word shapes: a word's runs of
letters, capitals, digits and single symbols, or a mark where the word repeats the one before; each n-gram of shapes is
also marked with the binary order of its share of the text. Indicators are scaled by the log-count ratio of the two classes, and a linear hinge-loss model is fitted by
dual coordinate descent; a logistic curve, fitted on rows that the model has not seen, turns margins into scores.

At most `rows` labelled ids, chosen by a hash, are used for fitting, one text each (the one whose features are smallest
where an id has several), and of these as many, in order of the hash, as hold `FEATURES` features together; scoring
reads every whole text in Arrow batches. Defined results: null text counts as empty; an empty text has no n-gram and gets the score of margin
`bias`; labels other than 0 and 1, or two different labels for one id, are not used; with one class only, or none, all
scores are that class's share (1 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm import words
from wirefold.llm.common import pick
from wirefold.llm.text_map import append_columns
from wirefold.session import cut_lineage

BITS = 18
ROWS, FEATURES = 12_000, 4_000_000
THRESHOLD = 0.7
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[words._SPACE] = 32
_SAME, _WORD = np.uint64(0x5A5A5A5A5A5A5A5B), np.uint64(0x3C3C3C3C3C3C3C3D)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word's shape, or the repeat mark, of each word itself, and where each text's words start."""
    data, offs = words.utf8(column)
    found, starts = [], []
    for a, part, _, s in words.chunks(data, offs):
        if not len(s):
            continue
        c = _CLASS[part]
        turn = np.append(True, c[1:] != c[:-1])
        turn[s] = True
        at = np.flatnonzero(turn & (c != 32))
        found.append(words.place_hashes(c[at], np.searchsorted(at, s), words.PLAIN))
        starts.append(s + a)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    shape = np.concatenate(found)
    own, at = words.word_hashes(column)
    same = np.append(False, own[1:] == own[:-1])
    same[at[:-1][at[:-1] < len(own)]] = False
    return np.where(same, _SAME, shape), own, np.searchsorted(np.concatenate(starts), offs)


def features(shape: np.ndarray, own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of one text, from its words' shapes and its words."""
    out = [words.mix(words.grams(own, n) ^ _WORD) for n in (1, 2)]
    for n in (1, 2, 3):
        g = words.grams(shape, n)
        if len(g):
            u, c = np.unique(g, return_counts=True)
            level = np.floor(np.log2(c / len(g) * 64)).astype(np.int64)
            out += [u, words.mix(u[level >= 0] + (level[level >= 0] + 1).astype(np.uint64))]
    return np.unique((np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int32))


def labelled(labels: DataFrame, allowed=None, rows: int = ROWS) -> DataFrame:
    """At most `rows` ids with one undisputed label, those with the smallest hashes."""
    given = pick(labels, doc_id="doc_id", quality="quality").filter("quality in (0, 1) and doc_id is not null")
    one = given.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("high"))
    one = one.filter("quality = high").select("doc_id", "quality")
    if allowed is not None:
        one = one.filter(allowed)
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_rows(docs: DataFrame, sample: DataFrame) -> list[tuple[np.ndarray, int]]:
    """Features and label of the sampled documents; the sample is bounded, so it is broadcast and collected."""
    marked = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")

    def make(column):
        shape, own, at = shapes(column)
        got = [features(shape[a:b], own[a:b]).astype(np.int32).tobytes() for a, b in zip(at, at[1:])]
        return [pa.array(got, pa.binary())]

    got = append_columns(marked, make, [T.StructField("f", T.BinaryType())])  # four bytes a feature on the driver
    one = cut_lineage(got.groupBy("doc_id", "quality").agg(F.min("f").alias("f")))
    upto = F.sum(F.octet_length("f") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # `rows` ids at most
    chosen = one.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= FEATURES).select("doc_id")
    rows = one.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "f").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["f"], np.int32), r["quality"]) for r in rows]


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: float = 0.1, epochs: int = 20,
            seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is one more feature of value 1."""
    w, b = np.zeros(len(values)), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([np.square(values[r]).sum() + 1 for r in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = values[r]
            g = y[i] * (x @ w[r] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w, b


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, smooth: float = 1.0) -> Model:
    """The model of labelled feature rows; every fifth row fits the logistic curve alone."""
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2 or len(rows) < 10:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1 - 1e-6
        return Model(np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    train = [r[0] for r, h in zip(rows, held) if not h]
    counts = [np.bincount(np.concatenate([f for f, q in zip(train, y[~held]) if q == k] or [np.zeros(0, int)]),
                          minlength=1 << bits) + smooth for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, b = descend(train, ratio, 2.0 * y[~held] - 1)
    weights = w * ratio
    on = held if held.any() and len(set(y[held].tolist())) == 2 else ~held
    margin = np.array([weights[r[0]].sum() + b for r, h in zip(rows, on) if h])
    slope, shift = logistic(margin, y[on])
    return Model(weights.astype(np.float32), float(b), slope, shift)


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood, with slightly drawn-in targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, v = np.stack([margin, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        v = v + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(v[0], 0.0)), float(v[1])


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs and a column `score`, 0 to 1, of every whole text."""
    def make(column):
        shape, own, at = shapes(column)
        m = np.array([model.weights[features(shape[a:b], own[a:b])].sum() + model.bias for a, b in zip(at, at[1:])], float)
        return [pa.array(1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -40, 40))))]

    return append_columns(docs, make, [T.StructField("score", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, allowed=None, rows: int = ROWS) -> Model:
    return fit(fit_rows(docs, labelled(labels, allowed, rows)))
