"""Category values that mean the same: suggest merges, review them, apply them.

A merge map has the columns ``column, cluster_id, original, merged_to,
approved``. Originals are compared stripped and lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import column, one_row, scalar_columns, text_columns
from tidewash.functions.frequencies import as_text, column_totals, value_frequencies
from tidewash.functions.scratch import write_scratch
from tidewash.functions.text import (
    canonical_list,
    comma_count,
    has_digit,
    is_blank,
    normalized,
    token_count,
    word_count,
)
from tidewash.operators.components import LAST_EDGES, clusters_within, connected_components
from tidewash.operators.decisions import approved_only
from tidewash.operators.similar import (
    cosine_pairs,
    sparse_cosine_pairs,
    sparse_zscore_pairs,
    trigram_terms,
    zscore_pairs,
)

MERGE_COLUMNS = ["column", "cluster_id", "original", "merged_to", "approved"]
MERGE_SCHEMA = (
    "column string, cluster_id string, original string, merged_to string, approved boolean"
)
COMMAS, WORDS = 2.0, 2.0
REVIEWED_COMMAS, REVIEWED_TOKENS, DOMINANT_PERCENT = 20.0, 50.0, 10.0


# ---- which columns to look at -------------------------------------------------


def text_shape_stats(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Average commas and words per value (as text) of every column."""
    names = scalar_columns(df) if names is None else list(names)
    found = one_row(
        df,
        [
            e
            for i, c in enumerate(names)
            for e in (
                F.avg(comma_count(as_text(df, c))).alias(f"c{i}"),
                F.avg(word_count(as_text(df, c))).alias(f"w{i}"),
            )
        ],
        fields=2,
    )
    return df.sparkSession.createDataFrame(
        [(c, found[f"c{i}"], found[f"w{i}"]) for i, c in enumerate(names)],
        "column string, avg_commas double, avg_words double",
    )


def merge_candidate_columns(df: DataFrame) -> list[str]:
    """Columns of any type whose values are short and hold few commas."""
    found = {
        r["column"]
        for r in text_shape_stats(df)
        .where((F.col("avg_commas") <= COMMAS) & (F.col("avg_words") <= WORDS))
        .collect()
    }
    return [c for c in scalar_columns(df) if c in found]


def reviewed_column_stats(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Dominant share, commas per value and tokens per distinct value of text columns."""
    names = text_columns(df, exclude=("ID",)) if names is None else list(names)
    freq = value_frequencies(df, names)
    tokens = (
        freq.select("column", normalized(F.col("value")).alias("value"))
        .distinct()
        .groupBy("column")
        .agg(F.avg(token_count(F.col("value"))).alias("avg_tokens"))
    )
    commas = freq.groupBy("column").agg(
        (F.sum(comma_count(F.col("value")) * F.col("n")) / F.sum("n")).alias("avg_commas")
    )
    totals = column_totals(freq).select(
        "column", (F.col("top_count") / F.col("total") * 100).alias("dominant_pct")
    )
    return totals.join(commas, "column").join(tokens, "column")


def reviewed_candidate_columns(df: DataFrame) -> list[str]:
    """Text columns with a dominant value, few commas and few tokens."""
    found = {
        r["column"]
        for r in reviewed_column_stats(df)
        .where(
            (F.col("dominant_pct") >= DOMINANT_PERCENT)
            & (F.col("avg_commas") <= REVIEWED_COMMAS)
            & (F.col("avg_tokens") <= REVIEWED_TOKENS)
        )
        .collect()
    }
    return [c for c in df.columns if c in found]


def distinct_normalized_values(df: DataFrame, name: str) -> DataFrame:
    """The distinct stripped, lower-cased, not blank values of a column."""
    value = as_text(df, name)
    return (
        df.select(normalized(value).alias("value")).where(F.col("value") != "").distinct()
    )


# ---- suggesting merges ----------------------------------------------------------


def canonical_merge_map(df: DataFrame, name: str) -> DataFrame:
    """Lists with the same items, whatever their separator, order, spacing and case.

    Only groups with more than one spelling are listed. Distinct values are
    counted first, so frequent values cost nothing extra.
    """
    spelled = (
        df.select(as_text(df, name).alias("original"))
        .where(F.col("original").isNotNull() & ~is_blank(F.col("original")))
        .distinct()
        .select("original", canonical_list(F.col("original")).alias("merged_to"))
    )
    several = (
        spelled.groupBy("merged_to").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return spelled.join(several, "merged_to").select(
        F.lit(name).alias("column"),
        F.col("merged_to").alias("cluster_id"),
        "original",
        "merged_to",
        F.lit(False).alias("approved"),
    )


def similarity_clusters(
    vectors: DataFrame,
    threshold: float | None = None,
    z: float | None = None,
    smallest: int = 2,
    largest: int = 20,
    recall: float | None = None,
) -> DataFrame:
    """``cluster_id, member, size``: values linked by similar vectors.

    Give either a cosine ``threshold`` or a ``z`` score. ``recall`` is that of
    :func:`tidewash.operators.similar.cosine_pairs`; without it all links are found.
    """
    if (threshold is None) == (z is None):
        raise ValueError("give either a threshold or a z-score")
    edges = (
        cosine_pairs(vectors, threshold, spanning=True, recall=recall)
        if z is None
        else zscore_pairs(vectors, z, spanning=True, recall=recall)
    )
    linked = connected_components(edges, last_edges=LAST_EDGES)
    return clusters_within(linked, smallest, largest)


def text_clusters(
    values: DataFrame,
    name: str = "value",
    threshold: float | None = None,
    z: float | None = None,
    smallest: int = 2,
    largest: int = 20,
) -> DataFrame:
    """``cluster_id, member, size``: distinct values linked by similar character trigrams.

    Give either a cosine ``threshold`` or a ``z`` score.
    """
    if (threshold is None) == (z is None):
        raise ValueError("give either a threshold or a z-score")
    terms = write_scratch(trigram_terms(values, name), "trigrams")
    edges = sparse_cosine_pairs(terms, threshold) if z is None else sparse_zscore_pairs(terms, z)
    linked = connected_components(edges, last_edges=LAST_EDGES)
    return clusters_within(linked, smallest, largest)


def shortest_merge_map(clusters: DataFrame, name: str) -> DataFrame:
    """Merge every cluster into its shortest member; ties go to the smallest.

    Clusters in which any member holds a digit are left out, because numbers
    tell apart what otherwise looks alike.
    """
    member = F.col("member").cast("string")
    targets = (
        clusters.groupBy("cluster_id")
        .agg(
            F.min(F.struct(F.length(member).alias("l"), member.alias("m"))).alias("first"),
            F.max(has_digit(member)).alias("digits"),
        )
        .where(~F.col("digits"))
    )
    return clusters.join(targets, "cluster_id").select(
        F.lit(name).alias("column"),
        F.col("cluster_id").cast("string").alias("cluster_id"),
        member.alias("original"),
        F.col("first.m").alias("merged_to"),
        F.lit(False).alias("approved"),
    )


#: A piece is crowded where its pairs are more than so many times its values.
CROWD = 16


def edit_candidates(values: DataFrame, distance: int = 1, name: str = "value") -> DataFrame:
    """``value_a, value_b, distance`` for distinct values within an edit distance.

    A text is cut into ``distance + 1`` pieces of about equal size; edits within
    the distance leave one piece of the shorter text whole, and shift it by at most
    the distance. So an equality join on the shorter length, the number of the piece
    and the piece finds all pairs: the shorter text gives its pieces, the longer one
    what stands at the places where a piece can have moved to. Memory is a fixed
    multiple of the text, and candidates are verified with the bounded distance.

    A piece that many values share (numbered names) would pair all of them. There the
    edits lie in what remains beside the piece, and two remainders that close have a
    text in common that is left after deleting up to ``distance`` characters from
    each; so these values are joined on the piece and the hash of such a text.
    """
    return edit_pairs(values, distance, name).withColumn(
        # The bounded distance is -1 beyond the bound.
        "distance", F.levenshtein("value_a", "value_b", distance)
    ).where(F.col("distance") >= 0)


def _left_after_deleting(rows: DataFrame, text: str, most: int) -> DataFrame:
    """``rows`` once for each different text left after up to ``most`` deletions, as its hash
    in place of ``text``."""
    others = [c for c in rows.columns if c != text]
    level = rows.select(*others, text, F.lit(1).alias("_from"))
    found = level
    for _ in range(most):
        level = (
            level.where(F.col("_from") <= F.length(text))
            .select(
                *others, text, F.explode(F.sequence(F.col("_from"), F.length(text))).alias("_at")
            )
            .select(
                *others,
                F.concat(
                    F.substring(text, F.lit(1), F.col("_at") - 1),
                    F.substring(text, F.col("_at") + 1, F.length(text)),
                ).alias(text),
                F.col("_at").alias("_from"),
            )
        )
        found = found.unionAll(level)
    return found.select(*others, F.xxhash64(text).alias(text)).distinct()


def edit_pairs(values: DataFrame, distance: int = 1, name: str = "value") -> DataFrame:
    """``value_a, value_b``: the candidates of :func:`edit_candidates`, not yet verified."""
    if distance < 1:
        raise ValueError("the distance must be one at least")
    distinct = write_scratch(
        values.select(normalized(F.col(name)).alias("v")).where(F.col("v") != "").distinct(),
        "values",
    )
    count = distance + 1
    length = F.length("v")

    def piece_start(size: Column, k: Column) -> Column:
        return F.floor(size * k / count).cast("int")

    numbers = F.sequence(F.lit(0), F.lit(distance))
    own = distinct.select("v", length.alias("size"), F.explode(numbers).alias("k"))
    start, end = piece_start(F.col("size"), F.col("k")), piece_start(F.col("size"), F.col("k") + 1)

    def beside(text: str, at: Column, width: Column) -> Column:
        """What remains of a text without a piece, with a mark in its place."""
        rest = F.substring(text, at + width + 1, F.length(text))
        return F.concat(F.substring(text, F.lit(1), at), F.lit("\0"), rest)

    key = ["size", "k", "piece"]
    pieces = own.select(
        F.col("v").alias("a"),
        "size",
        "k",
        start.alias("at"),
        (end - start).alias("width"),
        F.substring("v", start + 1, end - start).alias("piece"),
    )
    # The longer text, for each length a shorter partner may have.
    shorter = F.sequence(F.greatest(F.lit(1), length - distance), length)
    other = distinct.select("v", F.explode(shorter).alias("size")).select(
        "v", "size", F.explode(numbers).alias("k")
    )
    moved = F.explode(F.sequence(F.lit(-distance), F.lit(distance)))
    found = (
        other.select("v", "size", "k", moved.alias("shift"))
        .select(
            F.col("v").alias("b"),
            "size",
            "k",
            (start + F.col("shift")).alias("at"),
            (end - start).alias("width"),
        )
        .where((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.length("b")))
        .withColumn("piece", F.substring("b", F.col("at") + 1, F.col("width")))
    )
    sides = pieces.select(*key, F.lit(1).alias("of_a")).unionAll(
        found.select(*key, F.lit(0).alias("of_a"))
    )
    counts = sides.groupBy(*key).agg(F.sum("of_a").alias("na"), F.count("*").alias("n"))
    na, nb = F.col("na").cast("double"), F.col("n") - F.col("na")
    crowded = write_scratch(counts.where(na * nb > CROWD * (na + nb)).select(*key), "crowded")
    alone = pieces.join(crowded, key, "left_anti")
    pairs = alone.join(found.select("b", *key).distinct(), key).select("a", "b")
    if not crowded.isEmpty():
        rest_a, rest_b = (
            _left_after_deleting(
                side.join(crowded, key).select(
                    x, *key, beside(x, F.col("at"), F.col("width")).alias("rest")
                ),
                "rest",
                distance,
            )
            for x, side in (("a", pieces), ("b", found))
        )
        pairs = pairs.unionAll(rest_a.join(rest_b, [*key, "rest"]).select("a", "b"))
    return (
        pairs.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("value_a"), F.greatest("a", "b").alias("value_b"))
        .distinct()
    )


def edit_merge_map(df: DataFrame, name: str, distance: int = 1) -> DataFrame:
    """Suggest merging likely misspellings into the most frequent spelling.

    Spellings linked by small edits form a cluster, so every target stays as
    it is; equal counts go to the smallest text.
    """
    counts = (
        df.select(normalized(as_text(df, name)).alias("member"))
        .where(F.col("member") != "")
        .groupBy("member")
        .agg(F.count("*").alias("n"))
    )
    pairs = edit_candidates(counts, distance, "member")
    linked = connected_components(pairs, "value_a", "value_b", last_edges=LAST_EDGES).select(
        F.col("node").alias("member"), F.col("component").alias("cluster_id")
    )
    counted = linked.join(counts, "member")
    first = F.min(F.struct((-F.col("n")).alias("m"), "member"))
    targets = counted.groupBy("cluster_id").agg(first.alias("first"))
    return counted.join(targets, "cluster_id").select(
        F.lit(name).alias("column"),
        "cluster_id",
        F.col("member").alias("original"),
        F.col("first.member").alias("merged_to"),
        F.lit(False).alias("approved"),
    )


def synonym_merge_map(df: DataFrame, name: str, synonyms: DataFrame) -> DataFrame:
    """Suggest the merges that a table ``synonym, preferred`` holds for a column."""
    known = write_scratch(
        synonyms.select(
            normalized(F.col("synonym")).alias("value"), F.col("preferred").alias("merged_to")
        ),
        "synonyms",
    )
    return distinct_normalized_values(df, name).join(known, "value").select(
        F.lit(name).alias("column"),
        F.col("merged_to").alias("cluster_id"),
        F.col("value").alias("original"),
        "merged_to",
        F.lit(False).alias("approved"),
    )


def text_merge_map(
    df: DataFrame,
    name: str,
    threshold: float | None = 0.75,
    z: float | None = None,
    smallest: int = 2,
    largest: int = 20,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Cluster a column's values by vectors and merge each cluster into its shortest.

    ``vectors`` (``id`` = normalised value, ``vector``) may come from any
    model; without it, character trigrams are used.
    """
    if vectors is None:
        values = distinct_normalized_values(df, name)
        clusters = text_clusters(values, "value", threshold, z, smallest, largest)
    else:
        clusters = similarity_clusters(vectors, threshold, z, smallest, largest)
    return shortest_merge_map(clusters, name)


# ---- applying --------------------------------------------------------------------


def apply_merge_map(df: DataFrame, merge_map: DataFrame, names: Iterable[str]) -> DataFrame:
    """Replace the approved originals in text columns; other values stay as they are.

    The map is stored first, so Spark knows its size: a small one is broadcast
    and the table is not shuffled at all.
    """
    stored = write_scratch(
        approved_only(merge_map)
        .groupBy("column", normalized(F.col("original")).alias("_original"))
        .agg(F.min("merged_to").alias("_merged_to")),
        "merge-map",
    )
    current = df
    for name in [c for c in names if c in text_columns(df)]:
        one = stored.where(F.col("column") == name).select("_original", "_merged_to")
        current = (
            current.join(one, normalized(column(name)) == F.col("_original"), "left")
            .withColumn(name, F.coalesce("_merged_to", column(name)))
            .drop("_original", "_merged_to")
        )
    return current


def drop_rare_values(df: DataFrame, name: str, rare: DataFrame) -> DataFrame:
    """Drop the rows whose value is listed (``column, value``) and approved."""
    listed = write_scratch(
        approved_only(rare)
        .where(F.col("column") == name)
        .select(F.col("value").alias("_rare"))
        .distinct(),
        "rare",
    )
    return df.join(listed, column(name) == F.col("_rare"), "left_anti")
