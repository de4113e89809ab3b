from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import table, union_all, view, with_view
from catalog.registry import query
from tidewash.functions.columns import text_columns
from tidewash.functions.frequencies import distinct_counts, value_frequencies
from tidewash.functions.scratch import write_scratch
from tidewash.operators import correlation as R
from tidewash.operators import profile as P

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def _stats_sql(columns: list[str], source: str) -> str:
    return union_all(
        [
            f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean,
  round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
  round((SELECT {c}::DOUBLE FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 1), 4) AS mode,
  round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1,
  round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3,
  (SELECT count(*) FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_count
FROM {source}"""
            for c in columns
        ]
    )


@query("numeric_stats", _stats_sql(LINE_NUMBERS, "lineitem"))
def numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.numeric_stats(table(spark, sf, "lineitem"))


@query(
    "missing_summary",
    with_view(
        "dirty_customer",
        union_all(
            [
                f"SELECT '{c}' AS \"column\", count(*) AS total_rows, "
                f"count(*) - count({c}) AS missing_count, {excluded} AS excluded, "
                f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct "
                "FROM dirty_customer"
                for c, excluded in {
                    "custkey": "false",
                    "segment": "false",
                    "acctbal": "false",
                    "sparse_note": "true",
                    "nationkey": "false",
                }.items()
            ]
        ),
    ),
)
def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing_summary(view(spark, sf, "dirty_customer"), exclude=["sparse_note"])


ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


@query(
    "describe_dataset",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS num_unique, "
            f"count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct, "
            "count(*) AS total_rows, 6::BIGINT AS total_columns, count(*) * 6 AS total_cells "
            "FROM orders"
            for c, t in ORDER_TYPES.items()
        ]
    ),
)
def describe_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return P.describe_dataset(table(spark, sf, "orders"))


@query(
    "column_samples",
    """
WITH v AS (SELECT DISTINCT 'c_name' AS "column", c_name AS value FROM customer
  UNION SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer),
r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column"
  ORDER BY md5('0:' || value), value) AS k FROM v)
SELECT "column", string_agg(value, ' | ' ORDER BY k) AS samples FROM r WHERE k <= 3 GROUP BY "column"
""",
)
def column_samples(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return P.column_samples(value_frequencies(customer, text_columns(customer)), samples=3)


@query(
    "dataset_summary",
    with_view(
        "dirty_customer",
        """
SELECT count(*) AS "rows", 5::BIGINT AS cols,
  round((5 * count(*) - count(custkey) - count(segment) - count(acctbal) - count(sparse_note)
    - count(nationkey)) * 100.0::DOUBLE / (count(*) * 5), 2) AS null_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS duplicate_rows,
  3::BIGINT AS numeric_cols, 2::BIGINT AS categorical_cols, 0::BIGINT AS datetime_cols
FROM dirty_customer""",
    ),
)
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.dataset_summary(view(spark, sf, "dirty_customer"))


@query(
    "value_counts",
    with_view(
        "dirty_customer",
        """
SELECT segment AS value, count(*) AS count, round(count(*)::DOUBLE
  / (SELECT count(segment) FROM dirty_customer), 4) AS share
FROM dirty_customer WHERE segment IS NOT NULL GROUP BY segment""",
    ),
)
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_counts(view(spark, sf, "dirty_customer"), "segment")


@query(
    "top_values",
    """
WITH t AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS count FROM part GROUP BY p_name
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type),
r AS (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INTEGER AS place,
  value, count FROM t)
SELECT * FROM r WHERE place <= 5""",
)
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_values(table(spark, sf, "part"), ["p_name", "p_type"], 5)


@query(
    "dominant_value",
    with_view(
        "dirty_customer",
        union_all(
            [
                f"""
SELECT * FROM (SELECT '{c}' AS "column", {c} AS dominant_value, count(*) AS dominant_count,
  round(count(*) * 100.0::DOUBLE / (SELECT count({c}) FROM dirty_customer), 2) AS dominant_pct
FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
                for c in ("segment", "sparse_note")
            ]
        ),
    ),
)
def dominant_value(spark: SparkSession, sf: str) -> DataFrame:
    return P.dominant_values(view(spark, sf, "dirty_customer"), ["segment", "sparse_note"])


@query(
    "identifier_columns",
    """
WITH t AS (
  SELECT 'p_name' AS c, max(n) * 100.0::DOUBLE / sum(n) AS pct
    FROM (SELECT count(*) AS n FROM part GROUP BY p_name)
  UNION ALL SELECT 'p_brand', max(n) * 100.0::DOUBLE / sum(n)
    FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)
  UNION ALL SELECT 'p_type', max(n) * 100.0::DOUBLE / sum(n)
    FROM (SELECT count(*) AS n FROM part GROUP BY p_type))
SELECT c AS "column", round(pct, 4) AS top_pct FROM t WHERE pct < 10""",
)
def identifier_columns(spark: SparkSession, sf: str) -> DataFrame:
    return P.identifier_columns(table(spark, sf, "part"))


def _profile_number(c: str, source: str) -> str:
    x = f"{c}::DOUBLE"
    m = f"(SELECT avg({x}) FROM {source})"
    moment = {k: f"avg(power({x} - {m}, {k}))" for k in (2, 3, 4)}
    return f"""
SELECT '{c}' AS "column", 'numeric' AS kind, count({c}) AS count,
  count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values,
  round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(avg({x}), 4) AS mean,
  round(stddev_samp({x}), 4) AS stddev, round(quantile_cont({x}, 0.25), 4) AS q1,
  round(quantile_cont({x}, 0.5), 4) AS median, round(quantile_cont({x}, 0.75), 4) AS q3,
  count(*) FILTER (WHERE {c} = 0) AS zeros,
  round({moment[3]} / power({moment[2]}, 1.5), 4) AS skewness,
  round({moment[4]} / power({moment[2]}, 2) - 3, 4) AS kurtosis,
  NULL::VARCHAR AS top_text,
  round((SELECT {x} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 1), 4) AS top_number,
  (SELECT count(*) FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 1) AS top_count
FROM {source}"""


def _profile_text(c: str, source: str, kind: str = "categorical") -> str:
    top = f"(SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"
    nulls = ", ".join(
        f"NULL::DOUBLE AS {m}"
        for m in ("min", "max", "mean", "stddev", "q1", "median", "q3")
    )
    return f"""
SELECT '{c}', '{kind}', count({c}), count(*) - count({c}), count(DISTINCT {c}), {nulls},
  NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, (SELECT {c} FROM {top}), NULL::DOUBLE,
  (SELECT n FROM {top})
FROM {source}"""


@query(
    "column_profile",
    with_view(
        "docs_labelled",
        union_all(
            [_profile_number(c, "docs_labelled") for c in ("doc_id", "n_chars", "quality", "toxic")]
            + [_profile_text(c, "docs_labelled") for c in ("lang", "source")]
        ),
    ),
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.column_profile(view(spark, sf, "docs_labelled"))


@query(
    "rare_categories",
    """
WITH t AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS count FROM part GROUP BY p_name
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand),
s AS (SELECT *, count * 100.0::DOUBLE / (SELECT count(*) FROM part) AS share FROM t)
SELECT "column", value, count, round(share, 4) AS pct FROM s WHERE share < 1.5""",
)
def rare_categories(spark: SparkSession, sf: str) -> DataFrame:
    return P.rare_categories(table(spark, sf, "part"), ["p_name", "p_brand"], below=1.5)


# ---- correlation ---------------------------------------------------------------


def _pairs_sql(columns: list[str], source: str) -> str:
    return union_all(
        [
            f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, "
            f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"
            for a in columns
            for b in columns
            if a != b
        ]
    )


@query(
    "pearson_matrix",
    f"SELECT x, y, round(r, 6) AS r, n FROM ({_pairs_sql(LINE_NUMBERS, 'lineitem')})",
)
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    found = R.pearson_matrix(table(spark, sf, "lineitem"))
    return found.withColumn("r", F.round("r", 6))


PART_NUMBERS = ["id", "size", "price", "weight"]


@query(
    "pearson_matrix_with_gaps",
    with_view(
        "gappy_parts",
        f"SELECT x, y, round(r, 6) AS r, n FROM ({_pairs_sql(PART_NUMBERS, 'gappy_parts')})",
    ),
)
def pearson_matrix_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    found = R.pearson_matrix(view(spark, sf, "gappy_parts"))
    return found.withColumn("r", F.round("r", 6))


@query(
    "top_correlated",
    f"""
WITH c AS ({_pairs_sql(LINE_NUMBERS, 'lineitem')}),
k AS (SELECT x AS target, y AS "column", r,
  row_number() OVER (PARTITION BY x ORDER BY abs(r) DESC, y) AS place FROM c)
SELECT target, place::INTEGER AS place, "column", round(r, 6) AS r FROM k WHERE place <= 5""",
)
def top_correlated(spark: SparkSession, sf: str) -> DataFrame:
    found = R.top_correlated(table(spark, sf, "lineitem"))
    return found.withColumn("r", F.round("r", 6))


RANKED = f"""
SELECT y AS "column", r, n FROM ({_pairs_sql(LINE_NUMBERS, 'lineitem')})
WHERE x = 'l_extendedprice'"""


@query("pearson_ranking", f'SELECT "column", round(r, 6) AS r, n FROM ({RANKED})')
def pearson_ranking(spark: SparkSession, sf: str) -> DataFrame:
    found = R.pearson_ranking(table(spark, sf, "lineitem"), "l_extendedprice")
    # The p-value needs the beta function, which the checking SQL lacks.
    return found.select("column", F.round("r", 6).alias("r"), "n")


@query(
    "feature_sets",
    f"""
WITH k AS (SELECT "column", row_number() OVER (ORDER BY abs(r) DESC, "column") AS place FROM ({RANKED}))
SELECT 'feature_set_' || i AS feature_set, least(size, 7)::INTEGER AS features,
  (SELECT string_agg("column", ',' ORDER BY place) FROM k WHERE place <= size) AS columns
FROM (VALUES (1, 3), (2, 5), (3, 10)) AS s(i, size)""",
)
def feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    return R.feature_sets(table(spark, sf, "lineitem"), "l_extendedprice")


SKETCHED = ("l_quantity", "l_extendedprice", "l_partkey")


@query(
    "sketch_profile",
    union_all(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS n, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
  true AS quantiles_ok, true AS distinct_ok FROM lineitem"""
            for c in SKETCHED
        ]
    ),
)
def sketch_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the parts of a table, merged, and whether they keep their bounds."""
    items = table(spark, sf, "lineitem")
    merged = P.merge_sketches(P.sketch_profile(items, SKETCHED, by="l_returnflag"))
    # One row per column, but Spark can't know that: without the hints it deals all rows
    # out by column, of which there are three.
    report = write_scratch(P.sketch_report(merged), "report")
    probabilities = (0.25, 0.5, 0.75)
    rows = items.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in SKETCHED
                ]
            )
        ).alias("e")
    ).select("e.*")
    # The true ranks next to each estimate: values below it, and up to it.
    ranks = [
        e
        for p in probabilities
        for e in (
            F.count_if(F.col("value") < F.col(f"q{p * 100:g}")).alias(f"below{p * 100:g}"),
            F.count_if(F.col("value") <= F.col(f"q{p * 100:g}")).alias(f"upto{p * 100:g}"),
        )
    ]
    counted = rows.join(F.broadcast(report), "column").groupBy("column").agg(*ranks)
    exact = distinct_counts(items, SKETCHED).select("column", F.col("num_unique").alias("exact"))
    good = F.lit(True)
    for p in probabilities:
        low = F.col(f"below{p * 100:g}") / F.col("n") - P.RANK_ERROR
        high = F.col(f"upto{p * 100:g}") / F.col("n") + P.RANK_ERROR
        good = good & F.lit(p).between(low, high)
    off = F.abs(F.col("num_unique") - F.col("exact"))
    return report.join(F.broadcast(counted), "column").join(F.broadcast(exact), "column").select(
        "column",
        "n",
        "low",
        "high",
        good.alias("quantiles_ok"),
        (off <= P.DISTINCT_ERROR * F.col("exact")).alias("distinct_ok"),
    )
