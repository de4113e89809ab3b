"""Near duplicates by SimHash fingerprints that differ in few bits.

Candidates come from a segment-popcount embedding. The 64 bits are cut into
segments and a fingerprint is mapped to the vector of its segments' bit counts.
The Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints. The segments are dealt to axis groups, two more than the
allowed distance, so vectors within the distance agree exactly in at least two
groups: for every pair of groups the vector's part in them is a cell of a grid,
and only fingerprints in one cell are compared, first by Manhattan distance,
then exactly.

Only distinct fingerprints take part, so copies cost one row. A cell that holds
many fingerprints is not compared pair by pair: there every fingerprint meets
the others through the words one bit away, which finds the same links exactly
(for distances up to two) with 65 rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewash.functions.scratch import write_scratch
from tidewash.llm.registry import query, table
from tidewash.llm.words import text_blocks
from tidewash.operators.components import connected_components

BITS = 64
#: Bits of a segment: two keep three quarters of a random fingerprint's information.
SEGMENT_BITS = 2
#: Distinct fingerprints in a cell up to which its pairs are compared.
CELL_PAIRS = 32

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    stops = (ends[size - 1 :] - 1).tolist()
    return [digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """The word whose bits are set in over half of the hashes; zero without any."""
    if not hashes:
        return 0
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    # Hashes of a long text are counted in blocks, so that memory stays bounded.
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 65536):
        ones += np.unpackbits(values[at : at + 65536], axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(
    batches: Iterator[pa.RecordBatch], size: int, seed: int
) -> Iterator[pa.RecordBatch]:
    for batch, raw in text_blocks(batches):
        found = [fingerprint(shingle_hashes(text, size, seed)) for text in raw]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(found, pa.int64())], names=[*kept, "fp"]
        )


def simhash(
    docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``docs`` with ``fp``, the text's fingerprint as a signed 64-bit number, for the text."""
    rest = [c for c in docs.columns if c != text]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in rest]
    schema = T.StructType([*fields, T.StructField("fp", T.LongType())])
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprints(b, shingle, seed), schema)


def _signed(value: int) -> int:
    """The signed number with the same 64 bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def segment_counts(fp: Column) -> Column:
    """The bit counts of all two-bit segments, in unary: 00, 01 or 11 in the segment's place.

    The Manhattan distance of two vectors of counts is the number of bits in
    which their unary forms differ.
    """
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high), fp.bitwiseAND(high)
    return some.bitwiseAND(odd).bitwiseOR(F.shiftleft(both.bitwiseAND(odd), 1))


def manhattan(counts_a: Column, counts_b: Column) -> Column:
    return F.bit_count(counts_a.bitwiseXOR(counts_b))


def cells(counts: Column, distance: int) -> Column:
    """The grid cells of a vector of counts: one for every pair of axis groups."""
    groups, segments = distance + 2, BITS // SEGMENT_BITS
    masks = [
        sum(3 << (SEGMENT_BITS * s) for s in range(segments) if s * groups // segments == g)
        for g in range(groups)
    ]
    return F.array(
        *[
            F.struct(
                F.lit(number).alias("grid"),
                counts.bitwiseAND(F.lit(_signed(masks[a] | masks[b]))).alias("cell"),
            )
            for number, (a, b) in enumerate(combinations(range(groups), 2))
        ]
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all within ``distance``.

    ``prints`` has one row per distinct ``fp``. Every link is between fingerprints
    at most ``distance`` apart, and any two that close are connected by links. The
    way for crowded cells serves distance two; for other distances all cells are
    compared pair by pair.
    """
    counts = segment_counts(F.col("fp"))
    in_cells = write_scratch(
        prints.select("fp", F.explode(cells(counts, distance)).alias("at")).select(
            "fp", "at.grid", "at.cell"
        ),
        "cells",
    )
    sizes = in_cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = write_scratch(in_cells.join(sizes, ["grid", "cell"]), "crowds")
    sparse = held.where(F.col("n") <= CELL_PAIRS) if distance == 2 else held
    left, right = (sparse.select("grid", "cell", F.col("fp").alias(x)) for x in "ab")
    pairs = (
        left.join(right, ["grid", "cell"])
        .where("a < b")
        .where(manhattan(segment_counts(F.col("a")), segment_counts(F.col("b"))) <= distance)
        .where(hamming(F.col("a"), F.col("b")) <= distance)
        .select("a", "b")
    )
    if distance != 2:
        return pairs
    # Two fingerprints are at most two bits apart if and only if some word is at
    # most one bit from both; all that share a word are linked to its smallest.
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    around = (
        held.where(F.col("n") > CELL_PAIRS)
        .select("fp")
        .distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    )
    hubs = around.groupBy("middle").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"))
    stars = (
        around.join(hubs.where("n > 1").select("middle", "a"), "middle")
        .where(F.col("a") != F.col("fp"))
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.union(stars)


def _near_groups(found: DataFrame, distance: int) -> DataFrame:
    """``fp, component`` and the component's first ``key``, from rows of ``fp, key``."""
    prints = write_scratch(found.groupBy("fp").agg(F.min("key").alias("key")), "prints")
    nodes = connected_components(fingerprint_links(prints.select("fp"), distance), "a", "b")
    named = prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "key", F.coalesce("component", "fp").alias("component")
    )
    named = write_scratch(named, "named")
    first = named.groupBy("component").agg(F.min("key").alias("key"))
    return named.drop("key").join(first, "component")


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    seed: int = 42,
    distance: int = 2,
) -> DataFrame:
    """``id, fp, component_id`` for every row of ``docs``.

    Fingerprints link when at most ``distance`` bits differ; ``component_id`` is
    the smallest id that links reach, itself included. Defined results: texts
    without words (null, empty, blank) have fingerprint zero, which links like any
    other; texts of fewer words than a shingle are one shingle; a null id is its
    component's name only where all its members have null ids; an empty table
    gives an empty result. Other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = write_scratch(simhash(rows, "text", shingle, seed), "simhash")
    key = F.struct(F.col("id").isNull().alias("x"), "id").alias("key")
    groups = _near_groups(found.select("fp", key), distance)
    return found.join(groups, "fp").select(
        F.col("id").alias(id), "fp", F.col("key.id").alias("component_id")
    )


def keep_one_of_near(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    seed: int = 42,
    distance: int = 2,
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one with the smallest id.

    Rows with the same id in one group are told apart by a hash of their text;
    repeated rows count as one.
    """
    # Two hashes name a row's id and text, also where the id is null.
    row_id, row_text = F.col(f"`{id}`"), F.col(f"`{text}`")
    k1, k2 = F.xxhash64(row_id, row_text), F.xxhash64(row_text, F.lit(1), row_id)
    rows = docs.select(row_id.alias("id"), k1.alias("k1"), k2.alias("k2"), row_text.alias("text"))
    found = write_scratch(simhash(rows, "text", shingle, seed), "simhash")
    key = F.struct(F.col("id").isNull().alias("x"), "id", "k1", "k2").alias("key")
    groups = _near_groups(found.select("fp", key), distance)
    first = groups.select("key.k1", "key.k2").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    once = docs.select(k1.alias("k1"), k2.alias("k2"), whole).dropDuplicates(["k1", "k2"])
    return once.join(first, ["k1", "k2"], "left_semi").select("row.*")


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
