"""Best-fit decreasing packing of token documents into sequences of fixed length.

Best-fit decreasing looks only at lengths, and documents of one length are
interchangeable. So the plan is made from the number of pieces of each length (a
table of at most ``max_tokens`` rows for any corpus), one run of equal lengths at
a time, with a segment tree over the remaining capacities that finds the tightest
open sequences in logarithmic time. The plan says where the first, second, ...
piece of each length goes; the pieces get their rank within their length, and so
their place, in parallel.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewash.functions.scratch import write_scratch
from tidewash.llm.registry import query, table
from tidewash.llm.tokens import encoder, tokenizer_path
from tidewash.llm.words import text_blocks

MAX_TOKENS = 1024
END_ID = 2
_RANK_BITS = 44


class CapacityTree:
    """Which remaining capacities have open sequences; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that is open."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not self.count[node]:
                        node += 1
                return node - self.leaves
            node //= 2
        return None


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks from ``rank``: ``each`` to a sequence, side by side."""

    length: int
    rank: int
    sequence: int
    offset: int
    each: int


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """The slots of all pieces and the number of sequences.

    ``counts`` has the number of pieces of each length. The result is that of
    placing the pieces one by one, longest first, each in the tightest open
    sequence that has room. The number of slots depends on the capacity, not on
    the number of pieces.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, deque[tuple[int, int]]] = {}
    slots: list[Slot] = []
    opened = 0

    def leave(room: int, sequence: int, count: int) -> None:
        if room and count:
            runs.setdefault(room, deque()).append((sequence, count))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, sequence = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            else:
                sequence, count = runs[room].popleft()
                tree.add(room, -1)
            each = room // length
            full = min(count, left // each)
            last = min(left - full * each, each) if full < count else 0
            slots.append(Slot(length, rank, sequence, capacity - room, each))
            leave(room - each * length, sequence, full)
            if last:
                leave(room - last * length, sequence + full, 1)
            leave(room, sequence + full + bool(last), count - full - bool(last))
            rank += full * each + last
            left -= full * each + last
    return slots, opened


def _encode_pieces(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, most: int, checksums: bool
) -> Iterator[pa.RecordBatch]:
    """Pieces with their part of the input and their rank among the part's equal lengths."""
    last = pa.field("ids_crc32", pa.int64()) if checksums else pa.field("ids", pa.binary())
    part = TaskContext.get().partitionId()
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    ranks = np.zeros(most + 1, np.int64)
    for batch, raw in text_blocks(batches):
        texts = [t.decode("utf-8", "replace") for t in raw]
        rows, piece_of, starts, lengths, rank, ids = [], [], [], [], [], []
        for row, found in enumerate(encoder(path).encode(texts)):
            found += end
            total = len(found) // 4
            at, piece = 0, 0
            while at < total:
                size = (total - at) % most or most  # only the first piece can be shorter
                rows.append(row)
                piece_of.append(piece)
                starts.append(at)
                lengths.append(size)
                rank.append(ranks[size])
                ranks[size] += 1
                own = found[4 * at : 4 * (at + size)]
                ids.append(zlib.crc32(own) if checksums else own)
                at += size
                piece += 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(rows, pa.int64())),
                pa.array(piece_of, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(np.full(len(rows), part), pa.int32()),
                pa.array(rank, pa.int64()),
                pa.array(ids, last.type),
            ],
            names=["id", "piece", "start", "length", "part", "rank", last.name],
        )


def _place(batches: Iterator[pa.RecordBatch], slots: list[Slot]) -> Iterator[pa.RecordBatch]:
    ordered = sorted(slots, key=lambda s: (s.length, s.rank))
    keys = np.array([(s.length << _RANK_BITS) + s.rank for s in ordered], np.int64)
    lengths, ranks, sequences, offsets, each = (
        np.array([getattr(s, name) for s in ordered], np.int64)
        for name in ("length", "rank", "sequence", "offset", "each")
    )
    for batch in batches:
        rank, length = (batch.column(n).to_numpy() for n in ("rank", "length"))
        slot = np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1
        number = rank - ranks[slot]
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("rank", "part")}
        columns["sequence_id"] = pa.array(sequences[slot] + number // each[slot])
        columns["offset"] = pa.array(offsets[slot] + number % each[slot] * lengths[slot])
        yield pa.RecordBatch.from_pydict(columns)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int | None = END_ID,
    max_tokens: int = MAX_TOKENS,
    checksums: bool = False,
) -> DataFrame:
    """``id, piece, start, length, part, rank, ids`` (four bytes an id), stored once.

    With ``checksums`` the last column is ``ids_crc32``, worked out beside the ids, which
    then are not stored. A document is the ids of its whole text and then ``end_id``. One longer than
    ``max_tokens`` is cut into pieces of that length, of which the first may be
    shorter. ``tokenizer`` is a path that every worker can open.
    """
    kind = docs.schema[id].dataType.simpleString()
    last = "ids_crc32 long" if checksums else "ids binary"
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    pieces = rows.mapInArrow(
        lambda batches: _encode_pieces(batches, tokenizer, end_id, max_tokens, checksums),
        f"id {kind}, piece int, start long, length long, part int, rank long, {last}",
    )
    return write_scratch(pieces, "pieces", compression="zstd")


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``part`` and ``rank``.

    ``pieces`` needs ``part``, ``rank`` (0, 1, ... among the part's pieces of one
    length) and ``length``, and must give the same rows whenever it is read.
    Equal lengths are ordered by part and rank. Sequences are numbered from 0;
    the pieces of one fill it without gaps from offset 0.
    """
    counted = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counted = write_scratch(counted, "lengths")
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # max_tokens rows
    slots, _ = best_fit({r["length"]: r["n"] for r in totals}, max_tokens)
    earlier = Window.partitionBy("length").orderBy("part")
    before = counted.select(
        "length", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before")
    )
    ranked = pieces.join(before, ["length", "part"]).withColumn(
        "rank", F.col("rank") + F.col("before")
    )
    columns = [c for c in pieces.columns if c not in ("part", "rank")]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*pieces.columns).mapInArrow(
        lambda batches: _place(batches, slots), f"{schema}, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int | None = END_ID,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """``id, piece, start, length, ids, sequence_id, offset`` for every piece.

    Defined results: a null or empty text is its end id alone (without an end id
    it has no piece); repeated rows are separate documents; null ids are kept; an
    empty table gives an empty result. Other columns are not looked at.
    """
    pieces = token_pieces(docs, tokenizer, id, text, end_id, max_tokens)
    return pack_pieces(pieces, max_tokens).withColumnRenamed("id", id)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the whole sequences, from :func:`pack_documents`."""
    return packed.groupBy("sequence_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))),
                lambda p: p["h"],
            ),
            "",
        ).alias("h")
    ).select("sequence_id", F.unhex("h").alias("ids"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packing with a checksum in place of each piece's ids."""
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), checksums=True)
    return pack_pieces(pieces).select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        "sequence_id",
        "offset",
    )


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digests(table(spark, folder, "documents"))
