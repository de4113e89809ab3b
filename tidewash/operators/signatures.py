"""Pairs of vectors with a high cosine similarity, found by random hyperplanes.

A vector's signature says on which side of some random hyperplanes it lies. Two vectors
at an angle agree on one plane with probability 1 - angle / pi, so similar vectors often
share a whole signature. Several tables of signatures make it likely that
a pair shares one of them; pairs that do are compared exactly, so nothing
below the threshold is found, and a pair is given by the first table it shares.
The number of planes follows the number of vectors (buckets keep their size),
and the number of tables follows from the wanted recall at the threshold itself; pairs that
are more similar are found more often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewash.functions.columns import column
from tidewash.functions.scratch import write_scratch
from tidewash.functions.tiles import meet_within
from tidewash.operators.vectors import forest, unit_rows

TILE = 2048
STRIP = 512
#: Unrelated vectors that share one signature, about.
BUCKET = 256
MOST_BITS = 62


@dataclass(frozen=True)
class Signatures:
    """So many tables of signatures of so many bits."""

    tables: int
    bits: int
    seed: int = 0

    @staticmethod
    def for_recall(threshold: float, recall: float, rows: int, bucket: int = BUCKET) -> Signatures:
        """Tables that find a pair exactly at the threshold with probability ``recall``."""
        if not 0 < recall < 1:
            raise ValueError("the recall must lie between zero and one")
        bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2.0, rows / bucket)))))
        shared = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
        tables = 1 if shared >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - shared))
        return Signatures(tables, bits)

    def of(self, unit: np.ndarray) -> np.ndarray:
        """One row of signatures per vector."""
        planes = np.random.default_rng(self.seed).normal(
            size=(unit.shape[1], self.tables * self.bits)
        )
        sides = (unit @ planes > 0).reshape(len(unit), self.tables, self.bits)
        return sides @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def signature_pairs(
    vectors: DataFrame,
    threshold: float,
    recall: float = 0.95,
    strict: bool = False,
    spanning: bool = False,
    tile: int = TILE,
    block: str | None = None,
    signatures: Signatures | None = None,
) -> DataFrame:
    """``id_a, id_b, cosine`` for pairs of enough cosine that share a signature.

    ``vectors`` has a unique ``id`` and an array ``vector`` of one size. A pair at the
    threshold is found with probability ``recall``. With ``spanning`` a group gives
    only pairs that connect what its pairs connect. Pairs agree in ``block``, if given.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above zero")
    id_type = vectors.schema["id"].dataType.simpleString()
    element = vectors.schema["vector"].dataType.simpleString()
    key = F.lit("") if block is None else F.to_json(F.struct(column(block)))
    rows = write_scratch(
        vectors.where(F.col("vector").isNotNull()).select("id", "vector", key.alias("block")),
        "vectors",
    )
    chosen = signatures or Signatures.for_recall(threshold, recall, rows.count())

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(signs=list(chosen.of(unit_rows(batch["vector"]))))

    signed = write_scratch(
        rows.mapInPandas(sign, f"id {id_type}, vector {element}, block string, signs array<long>"),
        "signatures",
    )
    in_tables = signed.select(
        "id", "vector", "block", "signs", F.posexplode("signs").alias("number", "sign")
    )

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        number = some["number"].iloc[0]
        u, v = unit_rows(some["vector"]), unit_rows(others["vector"])
        ids, other_ids = some["id"].to_numpy(), others["id"].to_numpy()
        signs, other_signs = (np.stack(side["signs"].to_numpy()) for side in (some, others))
        itself = set(ids) == set(other_ids)
        found = []
        for start in range(0, len(u), STRIP):
            cosines = u[start : start + STRIP] @ v.T
            match = cosines > threshold if strict else cosines >= threshold
            if itself:
                match &= ids[start : start + STRIP][:, None] < other_ids[None, :]
            if spanning:
                found.append(np.array(forest(match)).T + [start, 0])
                continue
            i, j = np.nonzero(match)
            first = (signs[start + i] == other_signs[j]).argmax(axis=1) == number
            found.append(np.stack((i[first] + start, j[first]), axis=1))
        i, j = np.concatenate(found).T
        swap = ids[i] > other_ids[j]
        return pd.DataFrame(
            {
                "id_a": np.where(swap, other_ids[j], ids[i]),
                "id_b": np.where(swap, ids[i], other_ids[j]),
                "cosine": np.einsum("ij,ij->i", u[i], v[j]),
            }
        )

    schema = f"id_a {id_type}, id_b {id_type}, cosine double"
    return meet_within(in_tables, ["block", "number", "sign"], compare, schema, tile)
