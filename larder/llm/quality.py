"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are its distinct words and a few shape marks (shares of capitals and of single punctuation
marks, repeated neighbours, distinct words), all hashed into one weight vector. The model is
P(grade >= k) = sigmoid(w . x - threshold_k) with ordered thresholds shared by all grades; it gives the expected
grade and the tail probability by which documents are selected. Before the fit each feature is scaled by how well
it alone tells two neighbouring grades apart, so that the penalty weighs on words without evidence.

Fitting takes ``FIT_ROWS`` rated documents at most, chosen by a hash of their ids; scoring takes every whole
text, very long ones in pieces. Nulls: a null text is empty and scored as such; a rating with a null grade isn't used,
and a null mark makes a null grade. Several ratings of a document count each, repeated rows are scored each. Without
ratings of at least two grades nothing is rejected: expected grade and tail probability are null and every document is
kept. Empty tables give empty results. Other columns pass through ``select_quality``, whatever their names; ``classify`` leaves
out columns that are named like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.tokenizing import batches_by_bytes
from larder.llm.words import mixed, utf8, word_segments

#: Rated documents that a fit uses at most.
FIT_ROWS = 8192
BUCKETS = 1 << 18
#: A feature must occur in so many fitted documents to have a weight.
LEAST_DOCS = 3
#: A feature counts by the square of its evidence over this; a word without evidence can't hide one that tells grades apart.
EVIDENCE = 4.0
#: A document stays if it is more likely than not of the selected grade or a better one.
KEEP_FROM = 0.5


def _shape(doc: bytes, n_words: int, distinct: int, repeats: int) -> list[int]:
    """Marks of a text's form as numbers: (mark, step of its share)."""
    counts = np.bincount(np.frombuffer(doc, dtype=np.uint8), minlength=256) if doc else np.zeros(256, dtype=np.int64)
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[0xC3])
    step = lambda part, whole: 0 if not part else min(12, 1 + int(10 * part / max(whole, 1)))
    marks = [step(int(counts[65:91].sum()), letters), step(n_words - distinct, n_words), step(repeats, n_words), min(12, n_words.bit_length())]
    per_word = [0 if not c else min(8, 1 + int(2 * np.log2(1 + 16 * c / max(n_words, 1)))) for c in counts[33:48].tolist() + counts[58:65].tolist() + counts[91:97].tolist() + counts[123:127].tolist()]
    return [(1 << 40) + 64 * i + m for i, m in enumerate(marks + per_word) if m or i < len(marks)]


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' features, text by text, and the number of each text."""
    keys, totals, repeats = [], np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
    for s in word_segments(docs, fold=True, marks_apart=True):
        of = np.repeat(np.arange(s.first, s.first + len(s.counts)), s.counts)
        keys.append(of * BUCKETS + (s.hashes % np.uint64(BUCKETS)).astype(np.int64))
        totals[s.first : s.first + len(s.counts)] += s.counts
        same = (s.hashes[1:] == s.hashes[:-1]) & (of[1:] == of[:-1])
        np.add.at(repeats, of[1:][same], 1)
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    distinct = np.bincount(found // BUCKETS, minlength=len(docs)) if len(docs) else np.zeros(0, dtype=np.int64)
    shapes = [_shape(d, int(n), int(k), int(r)) for d, n, k, r in zip(docs, totals, distinct, repeats)]
    of_shape = np.repeat(np.arange(len(docs)), [len(x) for x in shapes])
    hashed = mixed(np.array([x for row in shapes for x in row], dtype=np.uint64)) % np.uint64(BUCKETS)
    every = np.unique(np.concatenate((found, of_shape * BUCKETS + hashed.astype(np.int64))))
    return every % BUCKETS, np.bincount(every // BUCKETS, minlength=len(docs)) if len(docs) else np.zeros(0, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights of the buckets in use, and ordered thresholds for the grades above the lowest."""

    grades: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, docs: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of grade ``least`` or better."""
        table = np.zeros(BUCKETS)
        table[self.buckets] = self.weights
        expected, tail = np.zeros(len(docs)), np.zeros(len(docs))
        above = int(np.searchsorted(self.grades, least))
        for part in batches_by_bytes(docs, 4 << 20):
            buckets, counts = features([docs[i] for i in part])
            link = np.bincount(np.repeat(np.arange(len(part)), counts), weights=table[buckets], minlength=len(part))
            tails = _sigmoid(link[:, None] - self.thresholds[None, :])
            expected[part.start : part.stop] = self.grades[0] + tails @ np.diff(self.grades)
            tail[part.start : part.stop] = 1.0 if above == 0 else 0.0 if above >= len(self.grades) else tails[:, above - 1]
        return expected, tail


def _scales(row: np.ndarray, column: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Squared evidence of each feature: its best score statistic between the documents of two neighbouring grades."""
    best = np.zeros(n)
    for j in range(int(y.max())):
        either = (y == j) | (y == j + 1)
        share = (y[either] == j + 1).mean()
        often = np.bincount(column, weights=either[row].astype(float), minlength=n)
        more = np.bincount(column, weights=np.where(either, (y == j + 1) - share, 0.0)[row], minlength=n)
        best = np.maximum(best, np.abs(more) / np.sqrt(np.maximum(often, 1) * share * (1 - share)))
    return (best / EVIDENCE) ** 2


def fit_model(buckets: np.ndarray, counts: np.ndarray, grades: np.ndarray, rounds: int = 200, penalty: float = 3e-3) -> Model | None:
    """Maximum likelihood with a ridge penalty, by Adam on all rows; None with fewer than two grades."""
    levels = np.unique(grades)
    if len(levels) < 2:
        return None
    used, inner, often = np.unique(buckets, return_inverse=True, return_counts=True)
    kept = often >= LEAST_DOCS
    to = np.cumsum(kept) - 1
    row = np.repeat(np.arange(len(counts)), counts)[kept[inner]]
    column, used = to[inner][kept[inner]], used[kept]
    y, k = np.searchsorted(levels, grades), len(levels) - 1
    scales = _scales(row, column, y, len(used))
    value = scales[column]
    share = np.clip([(y > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    # parameters: weights, first threshold, logarithms of the gaps
    p = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(used)
    for t in range(1, rounds + 1):
        gaps = np.exp(p[n + 1 :])
        thresholds = p[n] + np.concatenate(([0.0], np.cumsum(gaps)))
        link = np.bincount(row, weights=p[:n][column] * value, minlength=len(y))
        tails = np.concatenate((np.ones((len(y), 1)), _sigmoid(link[:, None] - thresholds), np.zeros((len(y), 1))), axis=1)
        slopes = tails * (1 - tails)
        at = np.arange(len(y))
        chance = np.maximum(tails[at, y] - tails[at, y + 1], 1e-9)
        up, down = slopes[at, y] / chance, slopes[at, y + 1] / chance  # of log chance by the lower and the upper tail's argument
        by_threshold = np.array([(down[y == j].sum() - up[y == j + 1].sum()) for j in range(k)]) / len(y)
        by_gap = np.array([by_threshold[j + 1 :].sum() for j in range(k - 1)]) * gaps
        by_weight = -np.bincount(column, weights=(up - down)[row] * value, minlength=n) / len(y) + penalty * p[:n]
        g = np.concatenate((by_weight, [-by_threshold.sum()], -by_gap))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    thresholds = p[n] + np.concatenate(([0.0], np.cumsum(np.exp(p[n + 1 :]))))
    return Model(levels.astype(float), used, p[:n] * scales, thresholds)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for good but toxic, 2 for good; null where a mark is missing that decides it."""
    return F.when(quality == 0, 0).when((quality > 0) & (toxic > 0), 1).when((quality > 0) & (toxic == 0), 2)


def fit(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model of ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade), of which ``fit_rows`` at most are used."""
    sample = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "grade").limit(fit_rows)
    rated = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "grade")), "doc_id").select("doc_id", "grade", "text")  # fit_rows bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            for part in batches_by_bytes(texts, 4 << 20):
                buckets, counts = features([texts[i] for i in part])
                at = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), batch.column(1).slice(part.start, len(part)), pa.ListArray.from_arrays(at, pa.array(buckets.astype(np.int32)))],
                    names=["doc_id", "grade", "buckets"],
                )

    rows = rated.select(F.col("doc_id").cast("long"), F.col("grade").cast("int"), "text").mapInArrow(run, "doc_id long, grade int, buckets array<int>")
    rows = rows.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "grade").limit(fit_rows).toArrow()
    if not rows.num_rows:
        return None
    lists = rows.column("buckets").combine_chunks()
    buckets, counts, grades = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(rows.column("grade"))
    return fit_model(buckets, counts, grades)


def score_column(model: Model | None, text: Column, least: int) -> Column:
    """Struct of expected_grade and tail_probability."""
    kind = "expected_grade double, tail_probability double"
    if model is None:
        return F.lit(None).cast(f"struct<{kind.replace(' double', ':double')}>")

    @F.pandas_udf(kind)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            expected, tail = model.score([x.encode() if x else b"" for x in texts], least)
            yield pd.DataFrame({"expected_grade": expected, "tail_probability": tail})

    return score(text)


def classify(docs: DataFrame, ratings: DataFrame, least: int = 2, keep_from: float = KEEP_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of grade ``least`` or better) and kept: from ``keep_from`` on."""
    model = fit(docs, ratings, fit_rows)
    own = ("expected_grade", "tail_probability", "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    scored = docs.select(row.alias("row"), score_column(model, F.col("text"), least).alias("score"))
    kept = F.coalesce(F.col("score.tail_probability") >= keep_from, F.lit(True))
    return scored.select("row.*", "score.expected_grade", "score.tail_probability", kept.alias("kept"))


def select_quality(docs: DataFrame, ratings: DataFrame, least: int = 2, keep_from: float = KEEP_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that stay, with their own columns."""
    model = fit(docs, ratings, fit_rows)
    if model is None:
        return docs
    return docs.filter(score_column(model, F.col("text"), least)["tail_probability"] >= keep_from)
