"""Quality by ordinal regression on graded ratings.

A cumulative-link model: one weight per hashed text feature, shared by all
grades, and ordered thresholds between the grades. ``P(grade >= k)`` is the
logistic function of the document's score less threshold ``k``. The features are
shares of hashed words, of word shapes (runs of letters, capitals, digits and
marks), of neighbouring shapes and of words that repeat the one before.

The model is fitted on a bounded sample of rated documents; every document is
scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewash.llm.registry import query, table
from tidewash.llm.words import (
    Words,
    cut_words,
    mix,
    stretch_hashes,
    text_blocks,
    text_of_rows,
)

#: Number of weights.
FEATURES = 1 << 16
#: Rated documents that the model is fitted on, at most (a hash of the id chooses, a
#: repeated id counts once).
RATED_DOCS = 8000

_LOWER_CLASS, _UPPER_CLASS, _DIGIT_CLASS = 1, 2, 3
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[range(0x61, 0x7B)] = _LOWER_CLASS
_CLASS[range(0x80, 0x100)] = _LOWER_CLASS
_CLASS[range(0x41, 0x5B)] = _UPPER_CLASS
_CLASS[range(0x30, 0x3A)] = _DIGIT_CLASS


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's classes of characters, runs taken once."""
    classes = _CLASS[words.buffer]
    keep = np.ones(len(classes), dtype=bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[words.starts] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    values = mix(classes[keep].astype(np.uint64))
    return stretch_hashes(values, place[words.starts], place[words.ends])


def feature_shares(words: Words, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and root of the feature's share, sorted by text."""
    if not len(words.starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0)
    own, shape, owner = words.hashes(), shapes(words), words.owner
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    again = own[follows + 1] == own[follows]
    kinds = [
        (own, owner),
        (mix(shape + np.uint64(1)), owner),
        (mix(shape[follows] * np.uint64(3) + shape[follows + 1]), owner[follows]),
        (np.where(again, mix(np.uint64([7])), mix(np.uint64([8]))), owner[follows]),
    ]
    keys = np.concatenate(
        [text * features + (h % np.uint64(features)).astype(np.int64) for h, text in kinds]
    )
    unique, counts = np.unique(keys, return_counts=True)
    text = unique // features
    size = np.maximum(1, np.diff(words.first))
    return text, unique % features, np.sqrt(counts / size[text])


@dataclass(frozen=True)
class OrdinalModel:
    """``weights`` for the features and ascending ``thresholds``, one less than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1, 2, ..., one column each."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    row: np.ndarray,
    feature: np.ndarray,
    value: np.ndarray,
    grades: np.ndarray,
    n_grades: int,
    features: int,
    rounds: int = 200,
    step: float = 0.3,
    shrink: float = 2e-5,
) -> OrdinalModel:
    """The model of smallest penalised log loss, by Adam over all rows in each round.

    Thresholds are the first one and the logarithms of their distances, so they
    stay in order. Grades without any row get a threshold next to their neighbour's.
    """
    n = len(grades)
    gaps = max(0, n_grades - 2)
    parameters = np.concatenate((np.zeros(features + 1), np.zeros(gaps)))
    if not n or n_grades < 2:
        return OrdinalModel(np.zeros(features), np.zeros(max(0, n_grades - 1)))
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)

    def thresholds_of(p: np.ndarray) -> np.ndarray:
        return p[features] + np.concatenate(([0.0], np.cumsum(np.exp(p[features + 1 :]))))

    for turn in range(1, rounds + 1):
        weights, thresholds = parameters[:features], thresholds_of(parameters)
        scores = np.bincount(row, weights[feature] * value, minlength=n)
        # P(grade = y) = S(upper) - S(lower), with S the logistic function of a
        # threshold less the score, 1 above the last grade and 0 below the first.
        padded = np.concatenate(([-np.inf], thresholds, [np.inf]))
        low = np.where(grades > 0, _logistic(padded[grades] - scores), 0.0)
        high = np.where(grades < n_grades - 1, _logistic(padded[grades + 1] - scores), 1.0)
        mass = np.maximum(high - low, 1e-9)
        slope_low, slope_high = low * (1 - low) / mass, high * (1 - high) / mass
        by_score = (slope_high - slope_low) / n  # of the loss, by the score
        gradient = np.empty_like(parameters)
        gradient[:features] = np.bincount(feature, by_score[row] * value, minlength=features)
        gradient[:features] += shrink * weights
        by_threshold = (
            np.bincount(grades, slope_low, minlength=n_grades)[1:]
            - np.bincount(grades, slope_high, minlength=n_grades)[:-1]
        ) / n
        gradient[features] = by_threshold.sum()
        after = np.cumsum(by_threshold[::-1])[::-1]
        gradient[features + 1 :] = after[1:] * np.exp(parameters[features + 1 :])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = step * (0.02 if turn > 0.9 * rounds else 0.2 if turn > 0.6 * rounds else 1)
        parameters = parameters - rate * (first / (1 - 0.9**turn)) / (
            np.sqrt(second / (1 - 0.999**turn)) + 1e-8
        )
    return OrdinalModel(parameters[:features].copy(), thresholds_of(parameters))


def _sample_features(
    batches: Iterator[pa.RecordBatch], features: int
) -> Iterator[pa.RecordBatch]:
    for batch, raw in text_blocks(batches):
        text, feature, value = feature_shares(cut_words(raw), features)
        ends = np.searchsorted(text, np.arange(len(raw) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("grade"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32))),
            ],
            names=["grade", "feature", "value"],
        )


def one_per_id(rows: DataFrame, id: str) -> DataFrame:
    """One row per id that is not null, chosen by a hash of the row; other rows go within tasks
    where they can."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kept = rows.where(F.col(f"`{id}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("_id"))
    return kept.agg(F.min_by(row, F.xxhash64(row)).alias("_row")).select("_row.*")


def rated_sample(ratings: DataFrame, id: str, most: int) -> DataFrame:
    """One row per id that is not null, and at most ``most`` rows, by the smallest hashes of the id."""
    return one_per_id(ratings, id).orderBy(F.xxhash64(id), id).limit(most)


def fit_quality(
    docs: DataFrame,
    ratings: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    grade: str = "grade",
    n_grades: int = 3,
    rated_docs: int = RATED_DOCS,
    features: int = FEATURES,
) -> OrdinalModel:
    """Fit on the documents of ``ratings`` (``id``, ``grade`` from 0 to ``n_grades - 1``).

    At most ``rated_docs`` ratings take part, one per id, and one document for each;
    so many ids are sent to the tasks, and the documents are read once. Rows with a
    null id or grade, or without a document, do not take part.
    """
    usable = ratings.select(
        F.col(f"`{id}`").alias("rated_id"), F.col(f"`{grade}`").cast("int").alias("grade")
    ).where(F.col("rated_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    chosen = rated_sample(usable, "rated_id", rated_docs)
    rated = (
        docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("rated_id"))
        .select("id", "grade", "text")
    )
    found = (
        one_per_id(rated, "id")
        .mapInArrow(
            lambda b: _sample_features(b, features),
            "grade int, feature array<int>, value array<float>",
        )
        .toArrow()
    )
    lists = found.column("feature").combine_chunks()
    values = found.column("value").combine_chunks()
    grades = found.column("grade").to_numpy().astype(np.int64)
    if not len(grades):
        return fit_ordinal(*(np.zeros(0, np.int64),) * 4, n_grades, features)
    row = np.repeat(np.arange(len(grades)), np.diff(lists.offsets.to_numpy()))
    # The order of the rows does not matter to the result beyond rounding.
    return fit_ordinal(
        row,
        lists.values.to_numpy(),
        values.values.to_numpy().astype(float),
        grades,
        n_grades,
        features,
    )


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for batch, raw in text_blocks(batches):
        text, feature, value = feature_shares(cut_words(raw), len(model.weights))
        scores = np.bincount(text, model.weights[feature] * value, minlength=len(raw))
        tails = model.tails(scores)
        flat = pa.array(tails.reshape(-1))
        ends = np.arange(len(raw) + 1, dtype=np.int32) * tails.shape[1]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in rest),
                batch.column("text"),
                pa.array(tails.sum(axis=1)),
                pa.ListArray.from_arrays(pa.array(ends), flat),
            ],
            names=[*rest, "text", "expected_grade", "tails"],
        )


def score_quality(
    docs: DataFrame, model: OrdinalModel, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, expected_grade, tails`` for every row; ``tails[k - 1]`` is ``P(grade >= k)``.

    Defined results: a text without words (null, empty, blank) has score zero, so
    its tails are those of the thresholds alone; repeated rows get equal results;
    an empty table gives an empty result. Other columns are not looked at.
    """
    kind = docs.schema[id].dataType.simpleString()
    return (
        docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(
            lambda b: (x.drop_columns(["text"]) for x in _score(b, model)),
            f"id {kind}, expected_grade double, tails array<double>",
        )
        .withColumnRenamed("id", id)
    )


def select_quality(
    docs: DataFrame, model: OrdinalModel, grade: int = 1, least: float = 0.5, text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with ``P(grade >= grade)`` of at least ``least``, all columns kept."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("tails", T.ArrayType(T.DoubleType())),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _score(text_of_rows(batches, text), model):
            yield found.select(["row", "tails"])

    kept = rows.mapInArrow(score, schema).where(F.get("tails", F.lit(grade - 1)) >= least)
    return kept.select("row.*")


def graded_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 poor, 1 good but toxic, 2 good."""
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, 0)
        .when(F.col("toxic") == 1, 1)
        .when(F.col("toxic") == 0, 2)
        .alias("grade"),
    )


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_quality(docs, graded_labels(table(spark, folder, "labels")))
    tails = F.col("tails")
    return score_quality(docs, model).select(
        "doc_id",
        "expected_grade",
        F.get(tails, F.lit(0)).alias("p_grade_1"),
        F.get(tails, F.lit(1)).alias("p_grade_2"),
        (F.get(tails, F.lit(0)) >= 0.5).alias("selected"),
    )
