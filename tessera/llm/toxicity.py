"""Toxicity by FTRL-proximal logistic regression on hashed features.

Features of a text are its distinct words, word pairs and skip-grams (a word
and the one after next), hashed to ``1 << BITS`` coordinates.  FTRL-proximal
keeps a learning rate per coordinate and its L1 term leaves most weights at exactly
zero, so the model that is sent to the executors is a short list, whose
size is bounded by the number of coordinates.

The fit reads at most ``MAX_TRAIN`` labelled rows (those whose hashed id is
smallest) with at most ``MAX_COORDINATES`` coordinates in all, whatever the size of the
corpus: both bounds hold what the driver keeps to about 100 MB.  A row that doesn't fit
what is left of the second bound is passed over.  Scoring covers every row and text.

Defined results: null or empty text scores what the bias alone says; labels
without a document and documents without a label are no training rows; of
repeated labels of an id the larger one counts; without labels nothing is known and
every score is 0.5; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, released, written

BITS = 22
MAX_TRAIN = 14_000
MAX_COORDINATES = 24_000_000  # distinct ones per row, summed over the training rows
EPOCHS = 5
RARE = 3  # coordinates of fewer training rows never get a weight
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
CACHE_WORDS = 400_000
_APART = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
_WORDS: dict[bytes, int] = {}
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


def coordinates(text: str | None) -> np.ndarray:
    """Hashed coordinates of all words, pairs and skip-grams, repeats included."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_APART).split()
    try:
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_WORDS) + len(words) > CACHE_WORDS:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * _P1 + h[1:]) * _P2
    skips = (h[:-2] * _P3 + h[2:]) * _P1
    return (np.concatenate((h, pairs, skips)) >> _SHIFT).astype(np.uint32)


@dataclass
class ToxicityModel:
    bias: float
    where: np.ndarray  # coordinates with a weight, ascending
    weight: np.ndarray

    @cached_property
    def dense(self) -> np.ndarray:
        """All coordinates' weights; made once in every Python worker."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.where] = self.weight
        return out

    def score(self, text: str | None) -> float:
        at = coordinates(text)
        at = at[self.dense[at] != 0]
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.dense[np.unique(at)].sum(), -35, 35))))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> ToxicityModel:
    """rows: distinct coordinates and label, in the order in which they are learned."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias, without L1
    often = np.zeros(size, np.int32)
    for at, _ in rows:
        often[at] += 1
    rows = [(at[often[at] >= RARE].astype(np.int64), y) for at, y in rows]
    del often
    for _ in range(epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0) / ((BETA + root) / ALPHA + L2)
            rb = np.sqrt(n[size])
            wb = -z[size] / ((BETA + rb) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - rb) / ALPHA * wb
            n[size] += g * g
    where = np.flatnonzero(np.abs(z[:size]) > L1)
    zi, ni = z[where], n[where]
    w = -np.sign(zi) * (np.abs(zi) - L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
    return ToxicityModel(float(-z[size] / ((BETA + np.sqrt(n[size])) / ALPHA + L2)), where.astype(np.uint32), w.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_TRAIN, max_coordinates: int = MAX_COORDINATES, epochs: int = EPOCHS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows with ``max_coordinates`` coordinates (documented bounds)."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("place", F.xxhash64("doc_id"))
    total = rows.count()
    if total > max_rows:  # first somewhat more than needed, then exactly so many, so that no task gets all
        share = min(1.0, (max_rows + 8 * max_rows**0.5 + 16) / total)
        rows = rows.filter(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        rows = rows.orderBy("place", "doc_id").limit(max_rows)
    chosen = F.broadcast(rows)  # max_rows rows at most
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id")

    def features(ids: list, texts: list, ys: list, places: list) -> Iterator[tuple]:
        for doc_id, text, y, place in zip(ids, texts, ys, places, strict=True):
            at = np.unique(coordinates(text))
            yield doc_id, place, y, len(at), at.tobytes()

    made = written(map_rows(
        picked, ["doc_id", "text", "y", "place"], features, "doc_id long, place long, y int, size long, at binary",
        ["doc_id", "place", "y", "size", "at"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()],
    ), "coordinates")
    # texts of repeated ids make more rows than labels, so the bound on rows holds here too
    keys = ["place", "doc_id", "size"]
    sizes = made.groupBy(keys).agg(F.count("*").alias("rows")).orderBy(keys).limit(max_rows)
    left, rows_left, fits, every = max_coordinates, max_rows, [], sizes.collect()
    for r in every:  # max_rows rows of four numbers
        if r["size"] * r["rows"] <= left and r["rows"] <= rows_left:
            left -= r["size"] * r["rows"]
            rows_left -= r["rows"]
            fits.append(tuple(r[k] for k in keys))
    if not fits:
        released(made)
        return ftrl([], epochs)
    fitting = made.select(*keys, "y", "at")
    if len(fits) < len(every) or len(every) == max_rows:  # not all of them
        fitting = fitting.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "place long, doc_id long, size long")), keys, "left_semi")  # max_rows rows at most
    fitting = fitting.toArrow()
    fitting = fitting.sort_by([(c, "ascending") for c in (*keys, "y")])
    # the coordinates stay in Arrow's buffers; ftrl copies only the frequent ones
    rows = [(np.frombuffer(at.as_buffer(), np.uint32), int(y > 0)) for at, y in zip(fitting.column("at"), fitting.column("y").to_pylist(), strict=True)]
    released(made)
    return ftrl(rows, epochs)


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the sparse weights go to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, shared.value.score(text)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, score double", ["doc_id", "score"], [pa.int64(), pa.float64()])
