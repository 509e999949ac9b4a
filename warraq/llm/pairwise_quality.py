"""A quality score learned from preferences, in the manner of Bradley and Terry.

A text labelled 1 is preferred to a text labelled 0, with probability sigmoid(score difference), and a
score is linear in features of the whole text. Weights come from logistic loss on feature differences
over pairs drawn from a bounded sample of labelled rows (``PER_LABEL`` rows of each label, chosen by
the hash of their id, and ``PAIRS`` pairs); every row is then scored where it is read. The cut is the
score quantile that separates the sample best, weighted by how often each label occurs among all
labelled rows; scores are shifted so that the cut stands at ``CUT``.

Edge cases: null and empty texts are scored by their (zero) features like any other. A row with a null
label is not learned from; without rows of both labels every score is ``CUT``. Repeated ids are scored row
by row and learned from once a label. Ties: equal texts have equal scores, and a score at the cut is predicted 1. Labels, language, source and ids are no features. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.quality_rules import STOP_WORDS
from warraq.llm.shingles import sequences, texts_of, words

PER_LABEL, PAIRS, CUT = 10_000, 60_000, 0.3
FOLDS, HELD_OUT = 5, 0
#: Number of features.
WIDTH = 26

_CLASSES = np.zeros(256, np.int64)  # 0 other, 1 space, 2 upper, 3 digit, 4 symbol, 5 shout, 6 stop and comma, 7 line end, 8 lower
_CLASSES[[32, 9, 11, 12, 13]] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[[ord(c) for c in "#*$%&|<>@^~_={}[]\\"]] = 4
_CLASSES[[ord(c) for c in "!?"]] = 5
_CLASSES[[ord(c) for c in ".,;:"]] = 6
_CLASSES[10] = 7
_CLASSES[97:123] = 8


def _stop_hashes() -> np.ndarray:
    return np.array([h[0] for h in words(pa.array(STOP_WORDS)) if len(h) == 1], np.uint64)


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    data, offsets = texts_of(column)
    stops = _stop_hashes()
    out = []
    for k, (w, s) in enumerate(zip(words(column), sequences(column), strict=True)):
        raw = data[offsets[k] : offsets[k + 1]]
        n, size = max(len(w), 1), max(len(raw), 1)
        kinds = np.bincount(_CLASSES[raw], minlength=9)
        stop = np.isin(w, stops).sum() / n
        _, counts = np.unique(w, return_counts=True)
        distinct = len(counts) / n
        top = counts.max() / n if len(counts) else 0.0
        again = (w[1:] == w[:-1]).sum() / n
        fresh = len(np.unique(s)) / max(len(s), 1) if len(s) else float(len(w) > 0)
        letters = max(kinds[2] + kinds[8], 1)
        length = (size - kinds[1] - kinds[7]) / n
        out.append(
            [
                float(len(w) > 0), np.log1p(len(w)), min(np.log1p(len(w)), 4.0), stop, max(0.0, 0.1 - stop), kinds[4] / n, min(kinds[4] / n, 0.1), kinds[2] / letters, min(kinds[2] / letters, 0.3),
                kinds[3] / size, kinds[5] / n, min(kinds[5] / n, 0.1), kinds[6] / n, kinds[7] / n, distinct, max(0.0, 0.3 - distinct), top, max(0.0, top - 0.2), fresh, max(0.0, 0.7 - fresh), length, max(0.0, length - 7.0), max(0.0, 4.0 - length), kinds[0] / size, again, min(again, 0.2),
            ]
        )
    return np.array(out, np.float64).reshape(len(out), WIDTH)


class PairwiseModel:
    """Weights, and the shift and slope that put the cut at ``CUT``."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, share_good: float, pairs: int = PAIRS, steps: int = 300, l2: float = 1e-3) -> PairwiseModel:
    """Logistic loss on feature differences by gradient descent with momentum."""
    width = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w, v = np.zeros(width), np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        v = 0.9 * v - 0.1 * (l2 * w - d.T @ p / pairs)
        w = w + v
    raw = z @ w
    weight = np.where(y == 1, share_good / len(good), (1 - share_good) / len(bad))
    order = np.argsort(raw)
    # Rows below a quantile are called bad: the weighted share of rows called right, for each quantile.
    right = share_good + np.cumsum(np.where(y[order] == 0, weight[order], -weight[order]))
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(best[len(best) // 2])
    cut = float(raw[order[k]] + raw[order[min(k + 1, len(raw) - 1)]]) / 2
    return PairwiseModel(mean, scale, w, cut, 1.0)


def fold(doc_id) -> object:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> PairwiseModel:
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").filter(fold(F.col("doc_id")) != HELD_OUT)
    share = known.agg(F.avg("quality")).first()[0] or 0.0
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.union(part)
    # At most 2 * per_label ids: small whatever the input. Of repeated ids one row is learned from, the one of the least hash.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), batch.column("h"), x], ["doc_id", "y", "h", "x"])

    told = rows.mapInArrow(run, "doc_id bigint, y int, h bigint, x array<double>")
    got = told.groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x")).select("x", "y").toArrow()
    x, y = np.array(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, WIDTH), got.column("y").to_numpy()
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)
    return fit(x[order], y[order], float(share)) if len(y) else fit(np.zeros((0, WIDTH)), np.zeros(0, int), 0.0)


def score(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """(doc_id, score) of every row."""
    mean, scale, weights, cut, slope = model.mean, model.scale, model.weights, model.cut, model.slope

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PairwiseModel(mean, scale, weights, cut, slope)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(own.score(features(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
