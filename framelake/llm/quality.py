"""Quality classifier: Bradley-Terry pairwise ranking over document statistics.

Each text has a strength ``w . x`` for a vector x of statistics; the model says that text a is
preferred to text b with probability ``sigmoid(w . (x_a - x_b))``. It is fitted by logistic loss on
the feature differences of preference pairs: each preferred text against several others, drawn by a
fixed rule. The strength's quantile at the share of rejected texts in the fit is the threshold, and
maps to a score of 0.3; a one-variable logistic fit gives the scale.

Features come from the text alone: sizes, byte classes, word shapes, repetition, and the share of
words among the frequent words of the fitting sample.

Defined results: a null or empty text has all statistics 0 and gets the score that these have;
equal texts score alike; repeated rows are scored once each; an empty table gives an empty result;
only the named columns are read. With labels of one kind only, or none, all scores are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import common, tokens


@dataclass(frozen=True)
class Params:
    """``most_rows`` bounds the labelled rows that the fit reads; ``rivals`` the pairs for each row of a label."""

    most_rows: int = 8000
    most_bytes: int = 24 << 20
    rivals: int = 12
    steps: int = 400
    l2: float = 1e-3
    frequent: int = 512
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    frequent: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float


_CLASSES = ("digit", "upper", "space", "line", "comma", "stop", "pipe", "other", "high")


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)
    t[48:58], t[65:91], t[32], t[10], t[44], t[46], t[124] = 0, 1, 2, 3, 4, 5, 6
    t[97:123] = 9
    t[128:] = 8
    return t


_CLASS = _class_table()


def statistics(arr: pa.Array, frequent: np.ndarray) -> np.ndarray:
    """One row of statistics a text; ``frequent``: sorted hashes of frequent words."""
    arr = tokens.as_texts(arr)
    n = len(arr)
    raw, off = tokens.buffers(arr)
    size = np.diff(off).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(off))
    cls = np.bincount(row_of * 10 + _CLASS[raw], minlength=n * 10).reshape(n, 10)[:, :9] / np.maximum(size, 1)[:, None]
    w = tokens.words(arr)
    count = np.bincount(w.row, minlength=n).astype(float)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    per = lambda x: np.bincount(w.row, x, n) / some
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length * length) - mean * mean, 0))
    order = np.lexsort((w.hash, w.row))
    h, r = w.hash[order], w.row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    kinds = np.bincount(r, fresh, n)
    run = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[fresh], run)
    same = lambda k: np.bincount(w.row[k:], (w.hash[k:] == w.hash[:-k]) & (w.row[k:] == w.row[:-k]), n) / some if len(w.hash) > k else np.zeros(n)
    pair, prow = tokens.grams(w, (0, 1))
    order = np.lexsort((pair, prow))
    pair, prow = pair[order], prow[order]
    twice = np.bincount(prow[1:], (pair[1:] == pair[:-1]) & (prow[1:] == prow[:-1]), n) / some if len(pair) > 1 else np.zeros(n)
    known = np.zeros(len(w.hash), bool)
    if len(frequent) and len(w.hash):
        at = np.minimum(np.searchsorted(frequent, w.hash), len(frequent) - 1)
        known = frequent[at] == w.hash
    commons = per(known)
    bound = np.flatnonzero(raw == 10)
    lines = np.bincount(row_of[bound], minlength=n) + 1.0 if n else np.zeros(0)
    stop = np.maximum(cls[:, 5] * size, 1)
    base = np.column_stack([np.log1p(size), np.log1p(count), mean, spread, cls, kinds / np.sqrt(some), kinds / some, top / some, same(1), same(2), same(3), twice, commons, np.log1p(size / lines), np.log1p(count / stop), per(length == 1), per(length > 12)])
    base[~np.isfinite(base)] = 0
    return base


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised, clipped statistics with their squares and products."""
    z = np.clip((x - mean) / scale, -4, 4)
    i, j = np.triu_indices(z.shape[1])
    return np.column_stack([z, z[:, i] * z[:, j]])


def frequent_words(texts: pa.Array, most: int) -> np.ndarray:
    seen = [tokens.words(part).hash for _, part in tokens.slices(texts)]
    h, n = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
    return np.sort(h[np.lexsort((h, -n))[:most]])


def fit_pairs(texts: pa.Array, labels: np.ndarray, p: Params = Params()) -> Model:
    frequent = frequent_words(texts, p.frequent)
    x = np.concatenate([statistics(part, frequent) for _, part in tokens.slices(texts)] or [statistics(pa.array([""]), frequent)[:0]])
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels != 1)
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(x.shape[1])
    z = _expand(x, mean, scale)
    w = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return Model(frequent, mean, scale, w, 0.0, 1.0, p.threshold)
    draw = lambda of, n, salt: of[(tokens.splitmix(np.arange(n, dtype=np.uint64) + np.uint64(salt)) % np.uint64(len(of))).astype(np.int64)]
    first = np.concatenate([np.repeat(good, p.rivals), draw(good, len(bad) * p.rivals, 1)])
    second = np.concatenate([draw(bad, len(good) * p.rivals, 2), np.repeat(bad, p.rivals)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, p.steps + 1):  # Adam over the full set of pairs
        s = z @ w
        miss = 1 / (1 + np.exp(np.clip(s[first] - s[second], -35, 35)))
        pull = np.bincount(first, miss, len(z)) - np.bincount(second, miss, len(z))
        g = -(pull @ z) / len(first) + p.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(s)))
    base, slope = float(np.log(p.threshold / (1 - p.threshold))), 1.0
    y = labels == 1
    for _ in range(200):  # one-variable Newton steps for the slope about the cut
        q = 1 / (1 + np.exp(-np.clip(base + slope * (s - cut), -35, 35)))
        d = s - cut
        slope = float(np.clip(slope + ((y - q) @ d) / max(1e-9, (q * (1 - q)) @ (d * d)), 0.05, 20))
    return Model(frequent, mean, scale, w, cut, slope, p.threshold)


def predict(arr: pa.Array, m: Model) -> np.ndarray:
    z = _expand(statistics(arr, m.frequent), m.mean, m.scale)
    return 1 / (1 + np.exp(-np.clip(np.log(m.threshold / (1 - m.threshold)) + m.slope * (z @ m.weights - m.cut), -35, 35)))


def train_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that the fit may learn from: crc32 of the id as text, mod 5, is not 0."""
    return labels.where(common.id_crc(id_col) % 5 != 0)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on a bounded sample of the labelled rows: ``p.most_rows``, or fewer if their texts have more than ``p.most_bytes``."""
    common.prepare(docs.sparkSession)
    lab = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    got = common.sample_texts(rows, lab, p.most_rows, p.most_bytes)
    m = fit_pairs(tokens.as_texts(got["_text"]), np.asarray(got["_y"].to_numpy(), float), p)
    del got
    tokens.trim()
    return m


def score(docs: DataFrame, m: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; the model is some hundreds of numbers."""
    common.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            out = [predict(part, m) for _, part in tokens.slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out or [np.zeros(0)]))], ["id", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole of ``documents``."""
    docs, p = common.read(spark, sf_dir, "documents"), Params()
    m = fit(docs, train_labels(common.read(spark, sf_dir, "labels")), p)
    return score(docs, m).select(
        F.col("id").alias("doc_id"),
        (common.id_crc("id") % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )
