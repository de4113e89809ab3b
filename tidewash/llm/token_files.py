"""Token ids in ORC files, in ascending id order, and back.

ORC's integer run-length encoding stores the ids; row indexes and Bloom filters
on the document id let a reader skip stripes and row groups. One shuffle brings
the texts into id order, every sorted partition is encoded and written as one
file, and each row keeps its place in its file, so the place in the whole order
needs only one number per file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewash.functions.scratch import scratch_folder
from tidewash.llm.registry import query, table
from tidewash.llm.tokens import encoder, tokenizer_path
from tidewash.llm.words import text_blocks

END_ID = 1
#: Bytes of a stripe and rows of an index entry; readers skip and split by these.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000


def _encode(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int | None
) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    before = 0
    for batch, raw in text_blocks(batches):
        found = [x + end for x in encoder(path).encode([t.decode("utf-8", "replace") for t in raw])]
        counts = np.array([len(x) // 4 for x in found], np.int64)
        ends = np.cumsum(counts)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        ids = np.frombuffer(b"".join(found), "<i4")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(np.full(len(raw), part), pa.int32()),
                pa.array(before + ends - counts, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
            ],
            names=["id", "part", "part_start", "n_tokens", "ids"],
        )
        before += int(ends[-1])


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int | None = END_ID,
    files: int | None = None,
) -> None:
    """Write ``id, part, part_start, n_tokens, ids`` to a new ORC folder.

    Files and the rows in them are in ascending id order (null ids first, equal
    ids by a hash of their text). A null text is empty and has its end id only.
    ``files`` defaults to the session's shuffle partitions. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # The hash lets many rows with one id spread over files.
    ordered = rows.repartitionByRange(files, "id", F.xxhash64("text")).sortWithinPartitions(
        "id", F.xxhash64("text")
    )
    encoded = ordered.mapInArrow(
        lambda batches: _encode(batches, tokenizer, end_id),
        f"id {kind}, part int, part_start long, n_tokens long, ids array<int>",
    )
    encoded.withColumnRenamed("id", id).write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": str(STRIPE_BYTES),
            "orc.create.index": "true",
            "orc.row.index.stride": str(INDEX_ROWS),
            "orc.bloom.filter.columns": id,
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(folder)


def read_tokens(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids`` from a folder of :func:`write_tokens`.

    ``start`` is the number of ids of all documents before. The totals of the
    files, one row each, are all that is brought together.
    """
    rows = spark.read.orc(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before")
    )
    return rows.join(F.broadcast(before), "part").select(
        id, (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("start"),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            names=["id", "start", "n_tokens", "ids_crc32"],
        )


def token_checksums(tokens: DataFrame, id: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32``, counted and summed from the ids themselves."""
    kind = tokens.schema[id].dataType.simpleString()
    return (
        tokens.select(F.col(f"`{id}`").alias("id"), "start", "ids")
        .mapInArrow(_checksums, f"id {kind}, start long, n_tokens long, ids_crc32 long")
        .withColumnRenamed("id", id)
    )


@query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, folder, "documents"), target, tokenizer_path("word_bpe_49k.json"))
    return token_checksums(read_tokens(spark, target))
