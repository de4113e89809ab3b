from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import table, union_all, view, with_view
from catalog.registry import query
from tidewash.operators import components as K
from tidewash.operators import merge as G
from tidewash.operators import similar as S
from tidewash.operators.decisions import approve
from tidewash.operators.profile import rare_categories
from tidewash.plans import cleaning as plans



@query(
    "text_shape_stats",
    with_view(
        "dirty_lists",
        """
SELECT 'id' AS "column", 0.0::DOUBLE AS avg_commas, 1.0::DOUBLE AS avg_words
UNION ALL SELECT 'tags', round(avg(len(tags) - len(replace(tags, ',', ''))), 6),
  round(avg(len(regexp_extract_all(tags, '\\S+'))), 6) FROM dirty_lists""",
    ),
)
def text_shape_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = G.text_shape_stats(view(spark, sf, "dirty_lists"))
    return stats.select(
        "column", *[F.round(c, 6).alias(c) for c in ("avg_commas", "avg_words")]
    )


@query(
    "merge_candidate_columns",
    """
WITH t AS (SELECT avg(len(text) - len(replace(text, ',', ''))) AS tc, avg(len(regexp_extract_all(text, '\\S+'))) AS tw,
  avg(len(regexp_extract_all(role, '\\S+'))) AS rw FROM conversations)
SELECT 'conv_id' AS "column" UNION ALL SELECT 'turn' UNION ALL SELECT 'role' FROM t WHERE rw <= 2
UNION ALL SELECT 'text' FROM t WHERE tc <= 2 AND tw <= 2""",
)
def merge_candidate_columns(spark: SparkSession, sf: str) -> DataFrame:
    names = G.merge_candidate_columns(table(spark, sf, "conversations"))
    return spark.createDataFrame([(n,) for n in names], "column string")


def _reviewed_sql(columns: list[str], source: str) -> str:
    return union_all(
        [
            f"""
SELECT '{c}' AS "column",
  (SELECT max(n) * 100.0::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})) AS dominant_pct,
  (SELECT avg(len({c}) - len(replace({c}, ',', ''))) FROM {source}) AS avg_commas,
  (SELECT avg(len(regexp_extract_all(v, '\\w+|[^\\w\\s]'))) FROM
    (SELECT DISTINCT lower(trim({c})) AS v FROM {source} WHERE {c} IS NOT NULL)) AS avg_tokens"""
            for c in columns
        ]
    )


@query(
    "reviewed_column_stats",
    f"""SELECT "column", round(dominant_pct, 4) AS dominant_pct, round(avg_commas, 4) AS avg_commas,
round(avg_tokens, 4) AS avg_tokens FROM ({_reviewed_sql(['p_name', 'p_brand', 'p_type'], 'part')})""",
)
def reviewed_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = G.reviewed_column_stats(table(spark, sf, "part"))
    return stats.select(
        "column",
        *[F.round(c, 4).alias(c) for c in ("dominant_pct", "avg_commas", "avg_tokens")],
    )


@query(
    "reviewed_candidate_columns",
    f"""SELECT "column" FROM ({_reviewed_sql(['p_name', 'p_brand', 'p_type'], 'part')})
WHERE dominant_pct >= 10 AND avg_commas <= 20 AND avg_tokens <= 50""",
)
def reviewed_candidate_columns(spark: SparkSession, sf: str) -> DataFrame:
    names = G.reviewed_candidate_columns(table(spark, sf, "part"))
    return spark.createDataFrame([(n,) for n in names], "column string")


CANONICAL = """
v AS (SELECT DISTINCT tags AS original, array_to_string(list_sort(list_transform(
    string_split_regex(lower(tags), '[,|/]'), lambda x: trim(x))), ', ') AS merged_to FROM dirty_lists),
canon AS (SELECT 'tags' AS "column", merged_to AS cluster_id, original, merged_to, false AS approved
  FROM v WHERE merged_to IN (SELECT merged_to FROM v GROUP BY merged_to HAVING count(*) > 1))"""


@query("merge_map_canonical", with_view("dirty_lists", f"WITH {CANONICAL} SELECT * FROM canon"))
def merge_map_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return G.canonical_merge_map(view(spark, sf, "dirty_lists"), "tags")


@query(
    "apply_merge_map",
    with_view(
        "dirty_lists",
        f"""WITH {CANONICAL}
SELECT id, coalesce((SELECT min(merged_to) FROM canon WHERE lower(trim(original)) = lower(trim(tags))), tags) AS tags
FROM dirty_lists""",
    ),
)
def apply_merge_map(spark: SparkSession, sf: str) -> DataFrame:
    lists = view(spark, sf, "dirty_lists")
    return G.apply_merge_map(lists, approve(G.canonical_merge_map(lists, "tags")), ["tags"])


@query(
    "merge_categories",
    with_view(
        "dirty_lists",
        f"""WITH {CANONICAL}
SELECT id, coalesce((SELECT min(merged_to) FROM canon WHERE lower(trim(original)) = lower(trim(tags))
  AND merged_to LIKE '%economy%'), tags) AS tags FROM dirty_lists""",
    ),
)
def merge_categories(spark: SparkSession, sf: str) -> DataFrame:
    def review(merge_map: DataFrame) -> DataFrame:
        return approve(merge_map, F.col("merged_to").contains("economy"))

    return plans.merge_categories(view(spark, sf, "dirty_lists"), ["tags"], review=review).data


@query("merge_without_approval", with_view("dirty_lists", "SELECT * FROM dirty_lists"))
def merge_without_approval(spark: SparkSession, sf: str) -> DataFrame:
    return plans.merge_categories(view(spark, sf, "dirty_lists"), ["tags"]).data


# ---- similarity -----------------------------------------------------------------

GRAMS = """
g AS (SELECT v, substr(p, i, 3) AS term
  FROM (SELECT v, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT v, ' ' || v || ' ' AS p FROM names))),
w AS (SELECT v, term, count(*)::DOUBLE AS n FROM g GROUP BY v, term),
l AS (SELECT v, sqrt(sum(n * n)) AS len FROM w GROUP BY v),
cos AS (SELECT a.v AS id_a, b.v AS id_b, sum(a.n * b.n) / (min(x.len) * min(y.len)) AS cosine
  FROM w a JOIN w b ON a.term = b.term AND a.v < b.v JOIN l x ON x.v = a.v JOIN l y ON y.v = b.v GROUP BY a.v, b.v)"""
PART_NAMES = "names AS (SELECT DISTINCT lower(trim(p_name)) AS v FROM part WHERE trim(p_name) <> '')"
TYPO_NAMES = "names AS (SELECT DISTINCT lower(trim(name)) AS v FROM typo_parts WHERE trim(name) <> '')"
TEXT_CUTOFF = 0.62


@query(
    "trigram_vectors",
    f"WITH {PART_NAMES}, {GRAMS} SELECT v AS id, term, n AS weight FROM w",
)
def trigram_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return S.trigram_terms(table(spark, sf, "part"), "p_name")


EMBEDDED = """
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cos AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS cosine
  FROM e a JOIN e b ON a.id < b.id)"""


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


@query(
    "cosine_pairs",
    f"WITH {EMBEDDED} SELECT id_a, id_b, round(cosine, 6) AS cosine FROM cos WHERE cosine >= 0.3",
)
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.cosine_pairs(embedded(spark, sf), 0.3).withColumn("cosine", F.round("cosine", 6))


SHIFTED = """
e AS (SELECT vec_id * 2 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL
  SELECT vec_id * 2 + 1, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 0.03125) FROM embeddings),
cos AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS cosine
  FROM e a JOIN e b ON a.id < b.id)"""


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector and a copy that is moved a little."""
    both = table(spark, sf, "embeddings").select(
        (F.col("vec_id") * 2).alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    moved = both.select(
        (F.col("id") + 1).alias("id"), F.transform("vector", lambda x: x + 0.03125).alias("vector")
    )
    return both.unionAll(moved)


@query(
    "cosine_pairs_signatures",
    f"WITH {SHIFTED} SELECT id_a, id_b, round(cosine, 6) AS cosine FROM cos WHERE cosine >= 0.9",
)
def cosine_pairs_signatures(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.cosine_pairs(shifted(spark, sf), 0.9, recall=0.999)
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query(
    "cosine_pairs_within",
    """
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cos AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS cosine
  FROM e a JOIN e b ON a.id < b.id AND a.label IS NOT DISTINCT FROM b.label)
SELECT id_a, id_b, round(cosine, 6) AS cosine FROM cos WHERE cosine >= 0.3""",
)
def cosine_pairs_within(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
    return S.cosine_pairs(rows, 0.3, block="label").withColumn("cosine", F.round("cosine", 6))


@query(
    "cosine_edges",
    with_view(
        "typo_parts",
        f"WITH {TYPO_NAMES}, {GRAMS} SELECT id_a, id_b, round(cosine, 6) AS cosine FROM cos WHERE cosine >= {TEXT_CUTOFF}",
    ),
)
def cosine_edges(spark: SparkSession, sf: str) -> DataFrame:
    terms = S.trigram_terms(view(spark, sf, "typo_parts"), "name")
    return S.sparse_cosine_pairs(terms, TEXT_CUTOFF).withColumn("cosine", F.round("cosine", 6))


ZSCORE = """m AS (SELECT count(*) AS n FROM e),
s AS (SELECT (2 * sum(cosine) + min(n)) / (min(n) * min(n)) AS mean,
  (2 * sum(cosine * cosine) + min(n)) / (min(n) * min(n)) AS sq FROM cos, m)"""


@query(
    "zscore_cutoff",
    f"""
WITH {EMBEDDED}, {ZSCORE}
SELECT min(n) AS vectors, round(min(mean), 6) AS mean, round(sqrt(min(sq) - min(mean) * min(mean)), 6) AS deviation,
  round(min(mean) + 1.5 * sqrt(min(sq) - min(mean) * min(mean)), 6) AS cutoff FROM s, m""",
)
def zscore_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The cutoff itself: one row, from one pass over the vectors."""
    n, mean, deviation = S.similarity_moments(embedded(spark, sf))
    return spark.createDataFrame(
        [(n, round(mean, 6), round(deviation, 6), round(mean + 1.5 * deviation, 6))],
        "vectors bigint, mean double, deviation double, cutoff double",
    )


@query(
    "zscore_clusters",
    f"""
WITH RECURSIVE {EMBEDDED}, {ZSCORE},
hits AS (SELECT id_a, id_b FROM cos, s WHERE cosine > mean + 3.4 * sqrt(sq - mean * mean)),
ed AS (SELECT id_a AS a, id_b AS b FROM hits UNION ALL SELECT id_b, id_a FROM hits),
reach(a, b) AS (SELECT a, a FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
c AS (SELECT a AS member, min(b) AS cluster_id, count(*) AS size FROM reach GROUP BY a)
SELECT cluster_id, member, size FROM c WHERE size BETWEEN 2 AND 20""",
)
def zscore_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by z-score: pairs that span them, not the listing of all edges."""
    return G.similarity_clusters(embedded(spark, sf), z=3.4)


def _clusters_sql(cutoff: float) -> str:
    return f"""
WITH RECURSIVE {EMBEDDED}, ed AS (SELECT id_a AS a, id_b AS b FROM cos WHERE cosine >= {cutoff}
  UNION ALL SELECT id_b, id_a FROM cos WHERE cosine >= {cutoff}),
reach(a, b) AS (SELECT a, a FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
c AS (SELECT a AS member, min(b) AS cluster_id, count(*) AS size FROM reach GROUP BY a)
SELECT cluster_id, member, size FROM c WHERE size BETWEEN 2 AND 20"""


@query("similarity_clusters", _clusters_sql(0.45))
def similarity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return G.similarity_clusters(embedded(spark, sf), threshold=0.45)


NAME_CLUSTERS = f"""
ed AS (SELECT id_a AS a, id_b AS b FROM cos WHERE cosine >= {TEXT_CUTOFF}
  UNION ALL SELECT id_b, id_a FROM cos WHERE cosine >= {TEXT_CUTOFF}),
reach(a, b) AS (SELECT a, a FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
c AS (SELECT a AS member, min(b) AS cluster_id, count(*) AS size FROM reach GROUP BY a),
keep AS (SELECT * FROM c WHERE size BETWEEN 2 AND 20),
short AS (SELECT cluster_id, arg_min(member, lpad(length(member)::VARCHAR, 4, '0') || member) AS merged_to
  FROM keep GROUP BY cluster_id HAVING NOT bool_or(regexp_matches(member, '[0-9]')))"""


@query(
    "merge_map_shortest",
    f"""
WITH RECURSIVE {PART_NAMES}, {GRAMS}, {NAME_CLUSTERS}
SELECT 'p_name' AS "column", cluster_id, member AS original, merged_to, false AS approved
FROM keep JOIN short USING (cluster_id)""",
)
def merge_map_shortest(spark: SparkSession, sf: str) -> DataFrame:
    return G.text_merge_map(table(spark, sf, "part"), "p_name", TEXT_CUTOFF)


SUGGEST_Z = 3.0


def _zscore_map_sql(column: str) -> str:
    """Shortest-member merge map of a column by the z-score of its similarities."""
    return f"""
SELECT * FROM (WITH RECURSIVE names AS (SELECT DISTINCT lower(trim({column})) AS v FROM spelled_parts
  WHERE trim({column}) <> ''),
{GRAMS}, m AS (SELECT count(*) AS n FROM names),
s AS (SELECT (2 * sum(cosine) + min(n)) / (min(n) * min(n)) AS mean,
  (2 * sum(cosine * cosine) + min(n)) / (min(n) * min(n)) AS sq FROM cos, m),
hits AS (SELECT id_a AS a, id_b AS b FROM cos, s WHERE cosine > mean + {SUGGEST_Z} * sqrt(sq - mean * mean)),
ed AS (SELECT a, b FROM hits UNION ALL SELECT b, a FROM hits),
reach(a, b) AS (SELECT a, a FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
c AS (SELECT a AS member, min(b) AS cluster_id, count(*) AS size FROM reach GROUP BY a),
keep AS (SELECT * FROM c WHERE size BETWEEN 2 AND 10),
short AS (SELECT cluster_id, arg_min(member, lpad(length(member)::VARCHAR, 4, '0') || member) AS merged_to
  FROM keep GROUP BY cluster_id HAVING NOT bool_or(regexp_matches(member, '[0-9]')))
SELECT '{column}' AS "column", cluster_id, member AS original, merged_to, false AS approved
FROM keep JOIN short USING (cluster_id))"""


@query(
    "merge_suggestions",
    with_view("spelled_parts", union_all([_zscore_map_sql(c) for c in ("name", "kind", "brand")])),
)
def merge_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The unreviewed variant over all columns: similarity by z-score, clusters of two to ten."""
    parts = view(spark, sf, "spelled_parts")

    def suggest(df: DataFrame, name: str) -> DataFrame:
        return G.text_merge_map(df, name, threshold=None, z=SUGGEST_Z, largest=10)

    names = G.merge_candidate_columns(parts)
    return plans.merge_categories(parts, names, suggest).reports["merge_map"]


EDITS = "edits AS (SELECT a.v AS value_a, b.v AS value_b, levenshtein(a.v, b.v) AS d FROM names a JOIN names b ON a.v < b.v)"


@query(
    "merge_candidates_edit",
    with_view(
        "typo_parts",
        f"WITH {TYPO_NAMES}, {EDITS} SELECT value_a, value_b, d::INTEGER AS distance FROM edits WHERE d <= 2",
    ),
)
def merge_candidates_edit(spark: SparkSession, sf: str) -> DataFrame:
    return G.edit_candidates(view(spark, sf, "typo_parts"), 2, "name")


EDIT_MAP = """
ed AS (SELECT value_a AS a, value_b AS b FROM edits WHERE d <= 1 UNION ALL SELECT value_b, value_a FROM edits WHERE d <= 1),
reach(a, b) AS (SELECT a, a FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
c AS (SELECT a AS member, min(b) AS cluster_id FROM reach GROUP BY a),
f AS (SELECT lower(trim(name)) AS member, count(*) AS n FROM typo_parts GROUP BY 1),
t AS (SELECT cluster_id, member, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, member) AS r
  FROM c JOIN f USING (member))"""


@query(
    "merge_map_edit",
    with_view(
        "typo_parts",
        f"""WITH {TYPO_NAMES}, {EDITS}, {EDIT_MAP}
SELECT 'name' AS "column", c.cluster_id, c.member AS original, t.member AS merged_to, false AS approved
FROM c JOIN t ON t.cluster_id = c.cluster_id AND r = 1""",
    ).replace("WITH typo_parts", "WITH RECURSIVE typo_parts", 1),
)
def merge_map_edit(spark: SparkSession, sf: str) -> DataFrame:
    return G.edit_merge_map(view(spark, sf, "typo_parts"), "name", 1)


@query(
    "merge_synonyms",
    with_view(
        "typo_parts",
        f"""WITH {TYPO_NAMES}, p AS (SELECT DISTINCT p_name AS good FROM part)
SELECT 'name' AS "column", min(good) AS cluster_id, v AS original, min(good) AS merged_to, false AS approved
FROM names JOIN p ON v = good || 's' GROUP BY v""",
    ),
)
def merge_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    # A lookup table of plural spellings, derived from the clean names.
    clean = table(spark, sf, "part").select(F.col("p_name").alias("preferred")).distinct()
    synonyms = clean.withColumn("synonym", F.concat("preferred", F.lit("s")))
    return G.synonym_merge_map(view(spark, sf, "typo_parts"), "name", synonyms)


@query(
    "drop_rare_categories",
    """
SELECT * FROM part WHERE p_name NOT IN (SELECT p_name FROM part GROUP BY p_name
  HAVING count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part) < 1.5)""",
)
def drop_rare_categories(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rare = rare_categories(part, ["p_name"], below=1.5).withColumn("approved", F.lit(True))
    return G.drop_rare_values(part, "p_name", rare)


@query(
    "connected_components",
    """
WITH RECURSIVE ed AS (SELECT DISTINCT s_suppkey AS a, s_nationkey + 1000000 AS b FROM supplier),
links AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""",
)
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id_a"), (F.col("s_nationkey") + F.lit(1000000)).cast("bigint").alias("id_b")
    )
    return K.connected_components(edges)
