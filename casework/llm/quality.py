"""Quality scores from pairwise preferences (operator 5, Bradley-Terry).

A document's strength is w . x, x a vector of figures of its text.  Of two
labelled documents of different label the better one should be preferred:
P(a over b) = 1 / (1 + exp(-w . (x_a - x_b))).  w minimises the logistic loss
of these preferences on feature differences, with a small L2 term.  The
threshold is a quantile of the training strengths, at the training share of
label 0; a logistic curve through (threshold, 0.3) turns strengths into scores
between 0 and 1.

The model is fitted on at most ``max_labelled`` labelled rows, those with the
smallest hash of doc_id; all other work covers every row.

Defined results: a null text is an empty one, whose figures are zero; labels
other than 0 and 1 and doc_ids with conflicting labels do not take part; with
no pair to learn from, every score is 0.5; repeated rows are scored alike;
other columns are kept and never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
MAX_LABELLED = 20_000
PAIRS_EACH = 12
_SIGNS = np.zeros(256)
_SIGNS[list(b"#$%&*!|@^~<>{}[]=+\\_/")] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LETTER = np.zeros(256)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_STOP = np.zeros(256)
_STOP[list(b".,;:?")] = 1
_KINDS = np.stack([_LETTER, _UPPER, _DIGIT, _SIGNS, _STOP], axis=1)
N_FEATURES = 24


def features(text: str | None) -> np.ndarray:
    """Figures of one whole text, most between 0 and 1."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(N_FEATURES)
    if not words:
        return out
    letters, upper, digits, signs, stops = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    n, size = len(words), len(raw)
    shown = max(1, letters + digits + signs + stops)
    pairs = list(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in pairs)
    lens = np.fromiter(map(len, words), np.int64, n)
    out[:14] = [
        np.log1p(n) / 10, np.log1p(size) / 15, lens.mean() / 10, min(lens.max(), 200) / 40,
        letters / shown, upper / max(1, letters), digits / shown, signs / shown, stops / n,
        len(set(words)) / n, np.log1p(n) / 10 * (len(set(words)) / n), same / n,
        len(set(pairs)) / max(1, n - 1), size / n / 10,
    ]
    seen, weight = set(), 0
    bad = np.zeros(6)
    for line in raw.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        m = len(line)
        weight += m
        k = np.bincount(np.frombuffer(line, np.uint8), minlength=256) @ _KINDS
        own = max(1, k[0] + k[2] + k[3] + k[4])
        bad[0] += m * (k[1] > 0.5 * max(1, k[0]))
        bad[1] += m * (k[3] > 0.06 * own)
        bad[2] += m * (len(set(parts)) < 0.5 * len(parts))
        bad[3] += m * (line in seen)
        bad[4] += m * (k[2] > 0.2 * own)
        bad[5] = max(bad[5], k[3] / own if len(parts) >= 5 else 0)
        seen.add(line)
    out[14:19] = bad[:5] / max(1, weight)
    out[19] = bad[5]
    out[20] = max(out[14:17])
    out[21:24] = out[[14, 15, 16]] > 0.3
    return out


@dataclass(frozen=True)
class Ranker:
    """Weights on standardised figures, the threshold strength and the slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _expand(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.slope * (self.strength(x) - self.threshold) + (np.log(THRESHOLD / (1 - THRESHOLD)) if self.slope else 0)
        return 1 / (1 + np.exp(-np.clip(at, -60, 60)))


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, np.abs(z)], axis=1)


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Bradley-Terry weights; each document of either label meets ``pairs_each`` of the other."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        k = x.shape[1]
        return Ranker(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0, 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _expand(x, mean, scale)
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, pairs_each), rng.choice(good, len(bad) * pairs_each)])
    b = np.concatenate([rng.choice(bad, len(good) * pairs_each), np.repeat(bad, pairs_each)])
    w, run = np.zeros(z.shape[1]), 1 << 15
    for _ in range(25):  # Newton steps, the pairs in runs of bounded size
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for i in range(0, len(a), run):
            diff = z[a[i:i + run]] - z[b[i:i + run]]
            miss = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))
            grad -= miss @ diff / len(a)
            hess += (diff * (miss * (1 - miss))[:, None]).T @ diff / len(a)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / len(x)))
    # between the last strength below and the first above, so that neither lies on the line
    low, high = s[s < threshold], s[s >= threshold]
    if len(low) and len(high):
        threshold = float((low.max() + high.min()) / 2)
    return Ranker(mean, scale, w, threshold, _slope(s - threshold, label))


def _slope(s: np.ndarray, label: np.ndarray) -> float:
    """The likeliest slope of a logistic curve through 0.3 at strength 0."""
    at, slopes = np.log(THRESHOLD / (1 - THRESHOLD)), np.geomspace(0.05, 20, 60)
    loss = [np.logaddexp(0, np.where(label == 1, -1, 1) * np.clip(k * s + at, -60, 60)).mean() for k in slopes]
    return float(slopes[int(np.argmin(loss))])


def held_out(id_col: str, folds: int = 5):
    """crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on labelled documents that are not held out."""
    clear = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
             .where("_y = _z").where(~held_out("_id")))
    sample = clear.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).select("_id", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tolist() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["_id", "_y", "x"])

    # at most max_labelled rows: bounded for the broadcast and for the driver
    rows = (docs.join(F.broadcast(sample), docs[id_col] == sample["_id"])
            .groupBy("_id", F.col("_y").cast("int").alias("_y")).agg(F.min(text_col).alias("_t"))
            .mapInArrow(run, "_id long, _y int, x array<double>").toPandas().sort_values("_id"))
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    return fit(x, rows["_y"].to_numpy(int))


def scored(docs: DataFrame, ranker: Ranker, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score for every row (a column of that name is replaced)."""
    keep = [c for c in docs.columns if c != score_col]

    @F.pandas_udf("double")
    def score(texts):
        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.Series(ranker.score(x))

    return docs.select(*keep, score(F.col(text_col)).alias(score_col))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with the columns of ``docs``."""
    ranker = train(docs, labels, max_labelled)
    mark = "_score"
    while mark in docs.columns:
        mark += "_"
    return scored(docs, ranker, score_col=mark).where(F.col(mark) >= threshold).drop(mark)
