"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another. A category's logistic model sees
the document's features and the probabilities of the categories before it. While
fitting, these probabilities are out of fold: each labelled document gets them
from models that have not seen it, as an unlabelled document would.

Features are words and the beginnings of words (so that forms of one stem share
weight) that a chi-square test finds to go with a category.

The chain is fitted on a bounded sample of labelled documents; every document is
scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewash.llm.decontaminate import _PLAIN
from tidewash.llm.quality import _logistic, one_per_id, rated_sample
from tidewash.llm.registry import query, table
from tidewash.llm.words import cut_words, mix, stretch_hashes, text_blocks
from tidewash.llm import words as _words

#: Labelled documents that the chain is fitted on, at most (a hash of the id chooses).
LABELLED_DOCS = 4000
#: Beginnings of words that are features beside the words, in bytes.
STEM_BYTES = (3, 4, 5)
#: A feature must go with a category at this chi-square (one degree of freedom).
LEAST_CHI2 = 40.0
FOLDS = 5

# English words that name two kinds of toxicity; the general one is labelled.
INSULTS = "clown dimwit fool idiot imbecile jerk loser moron scum".split()
DEMEANING = "disgusting pathetic repulsive stupid trash ugly useless worthless".split()


def doc_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature hash of every distinct feature, sorted by text."""
    words = cut_words([t.translate(_PLAIN) for t in texts])
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = _words._TABLES[1][words.buffer]
    found = [words.hashes()]
    owners = [words.owner]
    for size in STEM_BYTES:
        long = words.ends - words.starts > size
        starts = words.starts[long]
        stems = stretch_hashes(values, starts, starts + size)
        found.append(mix(stems + np.uint64(size)))
        owners.append(words.owner[long])
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]


@dataclass(frozen=True)
class Chain:
    """Sorted feature hashes; for each category weights of the features, of the
    earlier categories' probabilities, and a constant."""

    features: np.ndarray
    weights: list[np.ndarray]
    links: list[np.ndarray]
    constants: list[float]

    def probabilities(self, owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """One column per category."""
        known = np.zeros(len(hashes), bool)
        place = np.searchsorted(self.features, hashes)
        inside = place < len(self.features)
        known[inside] = self.features[place[inside]] == hashes[inside]
        row, place = owner[known], place[known]
        result = np.zeros((n, len(self.weights)))
        for k, (weights, links, constant) in enumerate(
            zip(self.weights, self.links, self.constants, strict=True)
        ):
            score = constant + np.bincount(row, weights[place], minlength=n)
            result[:, k] = _logistic(score + result[:, :k] @ links)
        return result


def fit_logistic(
    row: np.ndarray,
    place: np.ndarray,
    extra: np.ndarray,
    y: np.ndarray,
    size: int,
    rounds: int = 300,
    shrink: float = 1e-3,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of binary features and of dense extra columns, and the constant, by Adam."""
    n, dense = len(y), extra.shape[1]
    p = np.zeros(size + dense + 1)
    rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    p[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros_like(p), np.zeros_like(p)
    for turn in range(1, rounds + 1 if n else 1):
        score = np.bincount(row, p[place], minlength=n) + extra @ p[size:-1] + p[-1]
        error = (_logistic(score) - y) / n
        gradient = np.concatenate(
            (np.bincount(place, error[row], minlength=size), extra.T @ error, [error.sum()])
        )
        gradient[:-1] += shrink / 10 * p[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = 0.2 if turn < 0.7 * rounds else 0.02
        p = p - step * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return p[:size], p[size:-1], float(p[-1])


def telling(
    row: np.ndarray, place: np.ndarray, labels: np.ndarray, size: int
) -> np.ndarray:
    """Which of ``size`` features go with a category of the given documents by chi-square."""
    n, categories = labels.shape
    count = np.bincount(place, minlength=size)
    keep = np.zeros(size, bool)
    for k in range(categories):
        positive = labels[:, k].sum()
        hit = np.bincount(place, labels[row, k], minlength=size)
        # The chi-square of the two by two table of feature and category.
        spread = count * (n - count) * positive * (n - positive)
        chi2 = n * (hit * n - count * positive) ** 2 / np.maximum(spread, 1)
        keep |= (chi2 >= LEAST_CHI2) & (hit >= 3) & (hit * n > count * positive)
    return keep


def fit_chain(
    row: np.ndarray, hashes: np.ndarray, labels: np.ndarray, fold: np.ndarray
) -> Chain:
    """The chain over the columns of ``labels`` (0 or 1), in their order.

    The models of a fold see nothing of its documents: their features are chosen
    from the other folds too.
    """
    n, categories = labels.shape
    unique, place = np.unique(hashes, return_inverse=True)
    folds = []
    for f in range(FOLDS if categories > 1 else 0):
        train = fold != f
        seen = train[row]
        index = np.cumsum(train) - 1
        keep = telling(index[row[seen]], place[seen], labels[train], len(unique))
        number = np.cumsum(keep) - 1
        known = keep[place]
        folds.append(
            (
                train,
                index[row[seen & known]],
                number[place[seen & known]],
                row[known & ~seen],
                number[place[known & ~seen]],
                int(keep.sum()),
            )
        )
    keep = telling(row, place, labels, len(unique))
    number = np.cumsum(keep) - 1
    used = keep[place]
    row, place = row[used], number[place[used]]
    out_of_fold = np.zeros((n, 0))
    weights, links, constants = [], [], []
    for k in range(categories):
        y = labels[:, k].astype(float)
        parts = fit_logistic(row, place, out_of_fold, y, int(keep.sum()))
        weights.append(parts[0])
        links.append(parts[1])
        constants.append(parts[2])
        guess = np.zeros(n)
        for train, own_row, own_place, held_row, held_place, size in folds:
            w, link, constant = fit_logistic(
                own_row, own_place, out_of_fold[train], y[train], size
            )
            score = np.bincount(held_row, w[held_place], minlength=n) + out_of_fold @ link
            guess[~train] = _logistic(score + constant)[~train]
        out_of_fold = np.column_stack((out_of_fold, guess))
    return Chain(unique[keep], weights, links, constants)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw in text_blocks(batches):
        owner, hashes = doc_features(raw)
        ends = np.searchsorted(owner, np.arange(len(raw) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("labels"),
                batch.column("fold"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))),
            ],
            names=["labels", "fold", "hashes"],
        )


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    labelled_docs: int = LABELLED_DOCS,
) -> Chain:
    """Fit the chain on labelled documents; ``labels`` has a 0/1 column per category.

    A category's column may also be an SQL condition on ``words`` (the document's
    plain words as an array) and the columns of ``labels``. At most
    ``labelled_docs`` rows take part, one per id, and one document for each; so many
    are sent to the tasks, and the documents are read once. Rows with a null id or
    label, or without a document, do not take part. Other columns of ``labels`` may
    have any names; ``words`` in a condition is the document's.
    """
    # The document's columns have names of their own beside any that the labels may have.
    label = F.col(f"`{label_id}`")
    usable = labels.where(label.isNotNull()).withColumn("_labelled_id", label)
    chosen = rated_sample(usable, "_labelled_id", labelled_docs)
    lower = F.lower("_doc_text")
    plain = F.split(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ")
    rated = docs.select(
        F.col(f"`{id}`").alias("_doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_doc_text"),
    ).join(F.broadcast(chosen), F.col("_doc_id") == F.col("_labelled_id"))
    joined = (
        one_per_id(rated, "_doc_id")
        .withColumn("words", plain)
        .select(
            F.col("_doc_text").alias("text"),
            F.array(*[F.expr(c).cast("int") for c in categories]).alias("labels"),
            F.pmod(F.xxhash64("_doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("fold"),
        )
        .where(~F.exists("labels", lambda x: x.isNull()))
    )
    found = joined.mapInArrow(
        _features, "labels array<int>, fold int, hashes array<long>"
    ).toArrow()
    lists = found.column("hashes").combine_chunks()
    marks = found.column("labels").combine_chunks().values.to_numpy().reshape(-1, len(categories))
    row = np.repeat(np.arange(len(marks)), np.diff(lists.offsets.to_numpy()))
    return fit_chain(
        row, lists.values.to_numpy().view(np.uint64), marks, found.column("fold").to_numpy()
    )


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch, raw in text_blocks(batches):
        p = chain.probabilities(*doc_features(raw), len(raw))
        ends = np.arange(len(raw) + 1, dtype=np.int32) * p.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(p.reshape(-1))),
            ],
            names=["id", "p"],
        )


def score_toxicity(
    docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, p``: the categories' probabilities in the chain's order, for every row.

    Defined results: a text without words (null, empty, blank) gets the models'
    constants; repeated rows get equal results; an empty table gives an empty
    result. Other columns are not looked at.
    """
    kind = docs.schema[id].dataType.simpleString()
    return (
        docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(lambda b: _score(b, chain), f"id {kind}, p array<double>")
        .withColumnRenamed("id", id)
    )


def lexicon_condition(words: list[str]) -> str:
    """Labelled toxic, and with one of the words."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"toxic = 1 AND arrays_overlap(words, array({listed}))"


@query("op9_toxicity_chain")
def op9_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    names = ["insult", "demeaning", "toxic"]
    chain = fit_toxicity(
        docs,
        table(spark, folder, "labels"),
        [lexicon_condition(INSULTS), lexicon_condition(DEMEANING), "toxic"],
    )
    scored = score_toxicity(docs, chain)
    return scored.select(
        "doc_id",
        *[F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(names)],
        (F.get("p", F.lit(2)) >= 0.5).alias("toxic"),
    )
