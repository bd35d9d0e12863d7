"""Language identification by error-correcting output codes.

Every known language gets a codeword.  For every bit a binary classifier
(multinomial naive Bayes over hashed byte trigrams of the lower-cased text)
tells the languages with a 1 from those with a 0.  Its counts are sums over all
labelled rows, added up per partition first, so nothing is sampled.  A text's
bit margins are compared with all codewords by loss-weighted decoding: the
loss of each bit weighs as much as that bit's classifier is sure about the
language in question.  The nearest codeword wins; where the second one is almost
as near, the row is flagged as ambiguous.

Whether a text is in any known language at all is another question, as the nearest
codeword always wins by some share.  ``LanguageModel.known`` answers it: a text that is decoded to
within ``NEAR`` of a codeword is in that language.  Farther from all of them are texts in no known language and
those that mix many; ``LanguageModel.fit`` tells these apart: the mean
log-likelihood of the text's trigrams, each under the language that has it most (so
that mixed known languages fit), on a scale where trigrams drawn at random have
0 and the learned rows have 1 in the mean.  Words with digits (numbers, keys) are in
no language and don't count beside others; ``LEAST_FIT`` is asked for.

Defined results: null text or text without a letter is ``und`` with score
0; languages are those with a labelled row; without any, every row is ``und``; of languages that are
equally near the first in alphabetical order wins and the row is ambiguous; repeated rows are read once each; an
empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sliced

SLOTS = 1 << 13
PIECE = 1 << 20  # bytes of a text that are counted at a time
BLOCK = 256  # slots a row of partial counts holds
SHARES = 1024  # groups of tasks whose counts are added up first
SHARPNESS = 6.0
AMBIGUOUS = 0.15  # distance between the two nearest codewords
MAX_LANGUAGES = 512  # labels of more languages than that aren't languages; bounds what a task and the driver hold (64 KB each)
NEAR = 0.4  # distance to a codeword that is a language's own: at sf0.01 single texts have 0.07 to 0.38, texts in no known language 0.50 on (log 2 = 0.69: no bit says anything)
LEAST_FIT = 0.5  # nearer to random trigrams than to the learned rows: in no known language
_LETTER = regex.compile(r"\p{L}")
_DIGIT = re.compile(r"\d")
_ASCII_LETTER = regex.compile(r"[A-Za-z]")


def trigram_counts(text: str) -> np.ndarray:
    """How often each slot's trigrams stand in the text; piece by piece, so that long texts take no more memory."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(SLOTS, np.int64)
    for at in range(0, len(raw) - 2, PIECE):
        b = raw[at : at + PIECE + 2].astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        counts += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(19), minlength=SLOTS)
    return counts


def without_digits(text: str) -> str:
    """The words that hold no digit."""
    return " ".join([w for w in text.split() if w.isalpha() or not _DIGIT.search(w)])


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_ASCII_LETTER.search(text) or _LETTER.search(text))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 per class: all dichotomies up to 7 classes, else a random dense code."""
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= 7:
        columns = [[1] + [1 if c >> k & 1 else -1 for k in range(classes - 1)] for c in range((1 << (classes - 1)) - 1)]
        return np.array(columns).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    while True:
        code = rng.choice([-1, 1], size=(classes, bits))
        if len({r.tobytes() for r in code}) == classes and (np.abs(code.sum(0)) < classes).all():
            return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # bits x slots, float32
    trust: np.ndarray  # classes x bits, rows sum to 1
    familiar: np.ndarray  # per slot: 0 as random trigrams, 1 as the learned rows, in the mean

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(counts)
        code = codewords(len(languages))
        if not languages:
            return cls(languages, code, np.zeros((0, SLOTS), np.float32), np.zeros(code.shape), np.zeros(SLOTS))
        p = np.array([counts[x] for x in languages], float) + 0.5
        p /= p.sum(1, keepdims=True)
        most = np.log(p.max(0))
        learned = (p @ most).mean()
        familiar = (most - most.mean()) / max(learned - most.mean(), 1e-9)
        if not code.shape[1]:
            return cls(languages, code, np.zeros((0, SLOTS), np.float32), np.zeros(code.shape), familiar)
        rows = []
        for bit in code.T:
            rows.append(np.log(p[bit > 0].mean(0) / p[bit < 0].mean(0)))
        w = np.array(rows)
        usual = p @ w.T  # margin that a text of each class has in the mean
        w /= np.maximum(np.abs(usual).mean(0), 1e-9)[:, None]
        sure = np.maximum(p @ w.T * code, 1e-6)
        return cls(languages, code, w.astype(np.float32), sure / sure.sum(1, keepdims=True), familiar)

    def distances(self, text: str) -> np.ndarray:
        """Loss-weighted distances of the text's bit margins to all codewords."""
        counts = trigram_counts(text)
        margin = (self.weights @ counts.astype(np.float32)).astype(float) / counts.sum()
        return (self.trust * np.logaddexp(0, -2 * self.code * margin)).sum(1)

    def known(self, text: str | None) -> bool:
        """Whether the text is in a known language: decoded near to a codeword, or, far from all, of known trigrams.  One language alone has no bits."""
        if not self.languages or not has_letter(text):
            return False
        return len(self.languages) > 1 and bool(self.distances(text).min() <= NEAR) or self.fit(text) >= LEAST_FIT

    def fit(self, text: str | None) -> float:
        """How well the text's trigrams are known, whichever known languages they are in."""
        if not self.languages or not has_letter(text):
            return 0.0
        words = without_digits(text)
        counts = trigram_counts(words if has_letter(words) else text)
        return float(self.familiar @ counts / counts.sum())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the decision is ambiguous."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        distance = self.distances(text)
        nearness = np.exp(-SHARPNESS * (distance - distance.min()))
        order = np.argsort(distance, kind="stable")
        best = int(order[0])
        return self.languages[best], float(nearness[best] / nearness.sum()), bool(distance[order[1]] - distance[best] < AMBIGUOUS)


def learn(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Counts of all rows that have both columns, summed per language.

    More than ``max_languages`` different labels raise ValueError before anything is counted.
    Tasks' counts are added up in two steps, so no group holds a row of every task.
    """
    blocks = SLOTS // BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    if lang not in sums:
                        sums[lang] = np.zeros(SLOTS, np.int64)
                    sums[lang] += trigram_counts(text)
        share = TaskContext.get().partitionId() % SHARES
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * blocks), pa.array(range(blocks), pa.int32()), pa.array([share] * blocks, pa.int32()), pa.array([x.tobytes() for x in total.reshape(blocks, BLOCK)])],
                names=["lang", "block", "share", "counts"],
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "block": rows["block"].iloc[:1], "share": rows["share"].iloc[:1], "counts": [total.tobytes()]})

    known = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    if rows.select(F.col(lang_col).cast("string").alias("lang")).dropna().distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"column {lang_col} has more than {max_languages} different labels")
    schema = "lang string, block int, share int, counts binary"
    shares = known.mapInArrow(count, schema).groupBy("lang", "block", "share").applyInPandas(add, schema)
    parts = shares.groupBy("lang", "block").applyInPandas(add, schema).collect()
    counts: dict[str, np.ndarray] = {}
    for r in parts:  # languages x 8,192 counts
        counts.setdefault(r["lang"], np.zeros(SLOTS))[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return LanguageModel.from_counts(counts)


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bits x 8,192 floats

    def run(ids: list, texts: list) -> Iterator[tuple]:
        m = shared.value
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, *m.predict(text)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, lang_pred string, score double, ambiguous boolean",
                    ["doc_id", "lang_pred", "score", "ambiguous"], [pa.int64(), pa.string(), pa.float64(), pa.bool_()])


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in a known language by its codeword, all columns kept; a text that mixes known languages is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = None
        for batch in sliced(batches, 2048):
            at = batch.schema.get_field_index(text_col) if at is None else at
            keep = []
            for text in batch.column(at).to_pylist():
                keep.append(m.known(text))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
