"""Quality scores from pairwise preferences (Bradley-Terry).

Every pair of a better and a worse document says P(better beats worse) =
sigmoid(w . (x_better - x_worse)), x being features of the whole text. w is
fitted by Newton's method on the logistic loss of the feature differences, with
an L2 penalty. The cut is a quantile of the fitted documents' scores: the share of worse
documents among them. A document's score is sigmoid(slope * (w . x - cut) + logit(PREDICT_AT)),
so the cut lies at PREDICT_AT.

The fit uses at most `max_labelled` labelled rows (those whose doc_id has the smallest
hash); every document is scored.

Defined cases: null and empty texts are scored like any other text (all counts are 0);
labels that are null or belong to no document are left out; of several labels for a document the largest
counts; with no labels or one class only every score is 0.5; rows that repeat a doc_id are
each scored; other columns are ignored; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: predicted is 1 at this score and above.
PREDICT_AT = 0.3
MAX_LABELLED = 20_000
#: Better-worse pairs that the fit sees for each labelled row.
PAIRS_PER_ROW = 6
L2 = 1e-3
#: Words at which a text's features count for 0.7 of their size.
SURE_WORDS = 10
LEAST_SCALE = 0.02
SLOPE = 1.5

_CLASSES = [
    range(97, 123), range(65, 91), range(48, 58), [32], [10], [33], [124], [46, 44], [35, 36, 37, 38, 42], [60, 61, 62, 123, 125, 91, 93, 92, 47, 95], [63, 58, 59], [34, 39, 40, 41, 45], range(128, 256),
]
_TO_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _TO_CLASS[list(_c), _k] = 1


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, and how long and how repetitive words and lines are; then the number of words, which says how sure the others are."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TO_CLASS
    words = data.split()
    n, lines = len(words), [x for x in data.split(b"\n") if x]
    different = set(words)
    starts = sum(w[:1].isupper() for w in words)
    odd_end = sum(w[-1:] in _ODD for w in words)
    letters = counts[0] + counts[1] + counts[12]
    return np.concatenate([
        counts / max(len(data), 1),
        [len(data) / max(n, 1) / 10, len(different) / max(n, 1), len(different) / max(n, 1) ** 0.8, starts / max(n, 1), odd_end / max(n, 1), counts[1] / max(letters, 1), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1) / 100, (counts[7] / max(n, 1)), len(max(words, key=len, default=b"")) / 100, n],
    ])


_ODD = {bytes([c]) for c in b"!|*$%&#"}


@dataclass
class Ranker:
    """A fitted model: standardise, expand, weigh, then place the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + math.log(PREDICT_AT / (1 - PREDICT_AT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, and their squares; those of short texts are drawn to the mean, as a few words say little."""
    z = np.tanh((x[:, :-1] - mean) / scale / 3) * 3 * np.sqrt(x[:, -1:] / (x[:, -1:] + SURE_WORDS))
    return np.hstack([z, z * z])


def fit(x: np.ndarray, better: np.ndarray, seed: int = 7, pairs_per_row: int = PAIRS_PER_ROW) -> Ranker | None:
    """Fit on rows x, of which `better` (bool) are preferred to the others."""
    if better.all() or not better.any():
        return None
    # no difference below LEAST_SCALE counts as large, however alike the fitted texts are
    mean, scale = x[:, :-1].mean(0), np.maximum(x[:, :-1].std(0), LEAST_SCALE)
    z = expand(x, mean, scale)
    draw = np.random.default_rng(seed)
    n_pairs = pairs_per_row * len(x)
    diff = z[draw.choice(np.flatnonzero(better), n_pairs)] - z[draw.choice(np.flatnonzero(~better), n_pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -60, 60)))
        gradient = diff.T @ (p - 1) / n_pairs + L2 * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n_pairs + L2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    return Ranker(mean, scale, w, float(np.quantile(raw, 1 - better.mean())), SLOPE)


def held_out(doc_id) -> F.Column:
    """True where crc32 of the doc_id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker | None:
    """Fit on labelled documents that are not held out, at most `max_labelled` of them: of rows that repeat a doc_id, the text whose hash is least."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [features(x.as_py()).tolist() for x in batch.column(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "quality", "hash", "x"])

    found = rows.mapInArrow(extract, "doc_id long, quality int, hash long, x array<double>")
    found = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("x", "hash").alias("x")).toArrow()
    if not found.num_rows:
        return None
    order = np.lexsort([*np.array(found["x"].to_pylist()).T[:3], found["doc_id"].to_numpy()])  # the same model however rows arrive
    return fit(np.array(found["x"].to_pylist())[order], found["quality"].to_numpy()[order] > 0)


def score(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column(1)])
                s = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= PREDICT_AT).astype("i4"))], names=["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """The rows of `docs` that are predicted 1, with all their columns."""
    if model is None:
        return docs

    @F.pandas_udf("double")
    def quality(text):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in text])) if len(text) else [], dtype="float64")

    return docs.where(quality("text") >= PREDICT_AT)
