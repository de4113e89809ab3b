"""Exact duplicates by a sort of the whole contents, in DataFrame functions only.

Sampled splitters cut the order of (first characters, digest, hash of the id)
into buckets of about equal size, one shuffle brings every text to its bucket,
the bucket is sorted by the full normalised text (Spark's sort goes to disk when
it has to) and neighbours are compared in full. The hash of the id is part of
the order, so a text that fills a third of the table spreads over as many
buckets as its share; the few texts that cross a splitter are put together again
from one row per bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewash.functions.scratch import write_scratch
from tidewash.llm.registry import query, table

#: Buckets per shuffle partition: more than one, so that buckets dealt by hash even out.
BUCKETS_PER_PARTITION = 4
#: Sampled rows per bucket; a bucket's size varies by about a fifth.
SAMPLED_PER_BUCKET = 20
#: Characters of a text that a splitter holds; with the digest it stays small for any text.
PREFIX_CHARS = 64


def normalized(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(text: Column, row_id: Column) -> Column:
    return F.struct(
        F.substring(text, 1, PREFIX_CHARS).alias("p"),
        F.sha2(text, 256).alias("d"),
        F.xxhash64(row_id).alias("h"),
    )


def _splitters(rows: DataFrame, buckets: int) -> list:
    """At most ``buckets`` keys at even steps through a sample of the order."""
    count = rows.count()
    wanted = buckets * SAMPLED_PER_BUCKET
    sample = rows.sample(fraction=wanted / count, seed=17) if count > wanted else rows
    keys = sample.select(_key(F.col("t"), F.col("id")).alias("key"))
    firsts = (
        keys.repartitionByRange(buckets, "key")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("key").alias("key"))
    )
    return sorted(tuple(row.key) for row in firsts.collect())[1:]


def _bucket(key: Column, splitters: Column, count: int) -> Column:
    """The number of splitters at or below ``key``, by halving."""

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        after = F.get(splitters, middle) <= key
        return F.struct(
            F.when((low < high) & after, middle + 1).otherwise(low).alias("low"),
            F.when((low < high) & ~after, middle).otherwise(high).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(count).alias("high"))
    turns = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(count + 1)))))
    return F.aggregate(turns, start, halve)["low"]


def _runs(rows: DataFrame, text: Column, size: bool) -> DataFrame:
    """``rows`` in the order of their buckets, neighbours compared.

    ``rows`` has an ``id``, and its texts are ``text``, which is normalised before
    and after the shuffle, so that only the given columns travel. Adds ``first`` (the
    row begins a run of equal texts in its bucket), ``crosses`` (the text may also be
    in the next bucket), the bucket ``b``, the digest ``d``, ``crossing_text`` for the
    first rows of crossing runs and, if asked for, each run's ``smallest`` id and
    ``size``.
    """
    spark = rows.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(rows.select("id", normalized(text).alias("t")), buckets)
    keyed = rows.withColumn("key", _key(normalized(text), F.col("id")))
    if splitters:
        known = F.array(
            *[
                F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(h).alias("h"))
                for p, d, h in splitters
            ]
        )
        keyed = keyed.withColumn("b", _bucket(F.col("key"), known, len(splitters)))

        def same(splitter: Column) -> Column:
            return F.coalesce(
                (splitter["p"] == F.col("key.p")) & (splitter["d"] == F.col("key.d")), F.lit(False)
            )

        below, above = F.get(known, F.col("b") - 1), F.get(known, F.col("b"))
        keyed = keyed.withColumn("crosses", same(below) | same(above))
    else:
        keyed = keyed.withColumn("b", F.lit(0)).withColumn("crosses", F.lit(False))
    dealt = (
        keyed.withColumn("d", F.unhex("key.d"))
        .drop("key")
        .repartition("b")
        .withColumn("t", normalized(text))
    )
    in_order = Window.partitionBy("b").orderBy("t", F.col("id").asc_nulls_last())
    compared = dealt.withColumn("first", ~F.lag("t").over(in_order).eqNullSafe(F.col("t")))
    crossing = F.when(F.col("first") & F.col("crosses"), F.col("t")).alias("crossing_text")
    if not size:
        return compared.select("id", "row", "b", "first", "crosses", "d", crossing)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_run = Window.partitionBy("b", "run")
    return (
        compared.withColumn("run", F.sum(F.col("first").cast("long")).over(so_far))
        .select("id", "b", "run", "first", "crosses", "d", crossing)
        .withColumn("smallest", F.min("id").over(in_run))
        .withColumn("size", F.count(F.lit(1)).over(in_run))
        .drop("run")
    )


def _first_id(id: str) -> Column:
    """The smallest id (null last) and its bucket."""
    return F.min(F.struct(F.col(id).isNull().alias("x"), F.col(id).alias("id"), "b"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when they are identical after :func:`normalized`. Of equal
    texts the row with the smallest id stays. Defined results: a null text is
    the empty text; a null id sorts last, and ``keep_id`` is null only where a
    whole group has null ids; rows repeated with the same id form one group of
    which exactly one row stays; an empty table gives an empty result. Other
    columns are not looked at, whatever their names.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    runs = write_scratch(_runs(rows, F.col("text"), size=True), "runs")
    # One row per bucket and crossing text, so at most two per splitter.
    whole = (
        runs.where("first AND crosses")
        .groupBy("d", "crossing_text")
        .agg(
            F.sum("size").alias("whole_size"),
            _first_id("smallest").alias("whole_first"),
        )
        .select(F.col("d").alias("whole_d"), "whole_size", "whole_first.*")
        .withColumnsRenamed({"id": "whole_smallest", "b": "whole_b"})
        .drop("x")
    )
    joined = runs.join(
        F.broadcast(whole), F.col("crosses") & (F.col("d") == F.col("whole_d")), "left"
    )
    return joined.select(
        F.col("id").alias(id),
        F.when(F.col("crosses"), F.col("whole_smallest"))
        .otherwise(F.col("smallest"))
        .alias("keep_id"),
        F.when(F.col("crosses"), F.col("whole_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("first") & (~F.col("crosses") | (F.col("b") == F.col("whole_b")))).alias("kept"),
        F.lower(F.hex("d")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    The rows travel with their texts through the one shuffle of the sort.
    """
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{id}`").alias("id"), whole_row.alias("row"))
    runs = _runs(rows, F.col("row").getField(text), size=False)
    heads = write_scratch(runs.where("first"), "heads")
    whole = (
        heads.where("crosses")
        .groupBy("d", "crossing_text")
        .agg(_first_id("id").alias("whole_first"))
        .select(F.col("d").alias("whole_d"), F.col("whole_first.b").alias("whole_b"))
    )
    kept = heads.join(
        F.broadcast(whole), F.col("crosses") & (F.col("d") == F.col("whole_d")), "left"
    )
    return kept.where(~F.col("crosses") | (F.col("b") == F.col("whole_b"))).select("row.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""


@query("op8_exact_dedup", SQL)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))
