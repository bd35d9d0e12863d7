"""Quality score: random Fourier features, ridge regression, isotonic calibration.

A text becomes a short vector of statistics.  Standardised, these pass
through random Fourier features, whose inner products approximate a Gaussian kernel.
The ridge solution needs only sums over the labelled rows (the normal equations),
which every partition adds up on its own; their size is that of the feature map,
whatever the input.  A held-back part of the learning rows calibrates the raw
scores: a histogram of fixed bins, then pool-adjacent-violators.

Defined results: null and empty texts have the statistics 0 and a score like
any other; labels or ids that are null are no learning rows; of repeated labels
of an id the larger one counts; without labels every score is 0.5; repeated documents are scored once each; texts of any length count whole;
equal raw scores have equal calibrated ones; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, released, written

FEATURES = 192
RIDGE = 3.0
BINS = 1024
LOW, HIGH = -0.5, 1.5
BLOCKS = 32

_CLASSES = np.zeros((256, 9))
for _c in range(256):
    for _k, _in in enumerate((
        65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, chr(_c) in "#*$%&", chr(_c) in "|<>{}[]\\_=~^",
        chr(_c) in "!?", chr(_c) in ".,;:", _c >= 128, chr(_c) in " \t\n\v\f\r",
    )):
        _CLASSES[_c, _k] = _in
STATS = 9 + 9


def statistics(text: str | None) -> list[float]:
    """Shares of character classes, sizes, and how much repeats."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    if not words:
        return [0.0] * STATS
    shares = (np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ _CLASSES / len(b)).tolist()
    n = len(words)
    lines = [x for x in b.split(b"\n") if x]
    triples = n - 2
    seen = len(set(zip(words, words[1:], words[2:], strict=False))) if triples > 0 else 0
    sizes = list(map(len, words))
    return shares + [
        np.log1p(n), np.log1p(len(b) / n), np.log1p(max(sizes)), len(set(words)) / n ** 0.8,
        1 - seen / triples if triples > 0 else 0.0, 1 - len(set(lines)) / len(lines), np.log1p(len(b) / len(lines)),
        words.count(b"|") / n, sum([x <= 2 for x in sizes]) / n,
    ]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of every row."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, statistics(text)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, stats array<double>", ["doc_id", "stats"], [pa.int64(), pa.list_(pa.float64())])


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    phases: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ self.phases[0] + self.phases[1]) * np.sqrt(2 / FEATURES)
        return np.hstack((z, np.ones((len(z), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def pool_adjacent_violators(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of consecutive bins, by least squares."""
    heap: list[list[float]] = []
    for n, s in zip(count, total, strict=True):
        heap.append([float(n), float(s), 1])
        while len(heap) > 1 and heap[-2][1] * heap[-1][0] >= heap[-1][1] * heap[-2][0]:
            n2, s2, k2 = heap.pop()
            heap[-1] = [heap[-1][0] + n2, heap[-1][1] + s2, heap[-1][2] + k2]
    return np.repeat([s / n for n, s, _ in heap], [int(k) for _, _, k in heap])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, STATS)


def learn(stats: DataFrame, labels: DataFrame, *, calibration: Column | None = None, id_col: str = "doc_id", label_col: str = "quality", seed: int = 11) -> QualityModel | None:
    """Fit on all labelled rows; rows for which ``calibration`` holds only calibrate."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stats.join(y, "doc_id").withColumn("hold", F.coalesce(calibration, F.lit(False)) if calibration is not None else F.lit(False))
    rows = written(rows.select("stats", "y", "hold"), "labelled")  # three passes read it
    model = _fitted(rows, calibration is not None, seed)
    released(rows)
    return model


def _fitted(rows: DataFrame, calibrates: bool, seed: int) -> QualityModel | None:
    """Moments, normal equations and calibration over (stats, y, hold)."""
    moments = rows.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return None
    mean, spread = np.zeros(STATS), np.ones(STATS)
    for r in moments:
        mean[r["k"]], spread[r["k"]] = r["m"], max(r["s"], 1e-3)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, spread, (rng.normal(0, 1 / np.sqrt(STATS), (STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)))
    width = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            total += z.T @ np.hstack((z, np.array(batch.column(1).to_pylist(), float)[:, None]))
        if total.any():
            parts = [x.tobytes() for x in np.array_split(total, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [sum(np.frombuffer(x) for x in rows["part"]).tobytes()]})

    fit = rows.filter("not hold").select("stats", "y").mapInArrow(sums, "block int, part binary")
    parts = {r["block"]: r["part"] for r in fit.groupBy("block").applyInPandas(add, "block int, part binary").collect()}
    if not parts:
        return None
    total = np.frombuffer(b"".join(parts[k] for k in sorted(parts))).reshape(width, width + 1)
    penalty = np.diag([RIDGE] * FEATURES + [1e-6])
    model.weights = np.linalg.solve(total[:, :width] + penalty, total[:, width])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column(0))) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    held = rows.filter("hold") if calibrates else rows
    bins = held.select("stats", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    if not bins:
        bins = rows.select("stats", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    n, s = np.array([r["n"] for r in bins], float), np.array([r["s"] for r in bins], float)
    prior = s.sum() / n.sum()
    fitted = pool_adjacent_violators(n + 0.02, s + 0.02 * prior)
    centres = LOW + (np.array([r["bin"] for r in bins]) + 0.5) / BINS * (HIGH - LOW)
    model.steps = (centres, fitted)
    return model


def score(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, score) of every row of statistics."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    shared = stats.sparkSession.sparkContext.broadcast(model)  # statistics x features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.calibrated(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
