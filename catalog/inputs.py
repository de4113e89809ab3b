"""Input tables, and views over them that supply what the tables lack.

The view texts are valid in Spark SQL and in the checking engine. A view reads
its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_CUSTOMER_BODY = """
SELECT c_custkey AS custkey,
  CASE WHEN c_custkey % 97 = 0 OR c_custkey % 11 = 0 THEN NULL
       WHEN c_custkey % 7 = 0 THEN '   '
       WHEN c_custkey % 5 = 0 THEN concat('  ', c_mktsegment, ' ')
       ELSE lower(c_mktsegment) END AS segment,
  CASE WHEN c_custkey % 97 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 97 <> 0 AND c_custkey % 10 = 0 THEN c_name END AS sparse_note,
  CASE WHEN c_custkey % 97 <> 0 THEN c_nationkey END AS nationkey
FROM {customer}
"""

VIEWS = {
    "dirty_customer": f"{DIRTY_CUSTOMER_BODY} UNION ALL {DIRTY_CUSTOMER_BODY} "
    "WHERE c_custkey % 20 = 0",
    "docs_labelled": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
""",
    "dirty_lists": """
SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 0 THEN concat(lower(p_type), '|', lower(p_brand))
    WHEN 1 THEN concat(p_brand, ', ', p_type)
    WHEN 2 THEN concat(p_type, ' / ', p_brand)
    WHEN 3 THEN lower(p_type) ELSE p_type END AS tags
FROM {part}
""",
    "gappy_orders": """
SELECT o_orderkey, o_custkey, o_orderpriority,
  CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 50 < 3 THEN NULL ELSE o_totalprice END AS totalprice
FROM {orders}
""",
    # Prices go missing more often for urgent and for expensive orders; the
    # status is sometimes missing too, regardless of anything.
    "biased_orders": """
SELECT o_orderkey, o_orderpriority, o_totalprice AS price,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0)
         OR (o_totalprice > 400000 AND o_orderkey % 2 = 0) OR o_orderkey % 19 = 0
       THEN NULL ELSE o_custkey END AS custkey
FROM {orders}
""",
    "typed_orders": """
SELECT CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NA' WHEN o_orderkey % 11 = 0 THEN 'n/a'
       ELSE CAST(o_custkey AS STRING) END AS cust,
  CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 17 = 0 THEN 'NaN'
       ELSE concat(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING), 'e-2') END AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS late,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS priority
FROM {orders}
""",
    "number_texts": """
SELECT event_id,
  CASE event_id % 10 WHEN 0 THEN concat('  ', CAST(user_id AS STRING), ' ')
    WHEN 1 THEN concat('1_', CAST(100 + user_id % 900 AS STRING))
    WHEN 2 THEN concat(CAST(user_id AS STRING), '.5d')
    WHEN 3 THEN concat('-', CAST(user_id AS STRING), 'e2')
    WHEN 4 THEN 'Infinity' WHEN 5 THEN 'nan' WHEN 6 THEN event_type
    WHEN 7 THEN '' WHEN 8 THEN concat('+', CAST(user_id AS STRING), '.25')
    ELSE NULL END AS written
FROM {events}
""",
    "typo_parts": """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 29 = 0 THEN replace(p_name, 'e', '')
       WHEN p_partkey % 31 = 0 THEN concat(p_name, 's')
       WHEN p_partkey % 37 = 0 THEN upper(p_name)
       WHEN p_partkey % 41 = 0 THEN concat(' ', p_name) ELSE p_name END AS name
FROM {part}
""",
    # Names with misspellings of their own: groups of two or three that belong together.
    "spelled_parts": """
SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, 's')
    WHEN 2 THEN upper(p_name) ELSE concat(p_name, 'es') END AS name,
  CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN concat(p_type, 's') ELSE p_type END AS kind,
  p_brand AS brand
FROM {part}
""",
    "gappy_parts": """
SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 3.0 + p_retailprice / 10 END AS weight,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS type
FROM {part}
""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_view(name: str, sql: str) -> str:
    """``sql`` with the view in front, for the checking engine."""
    body = VIEWS[name].format(**{t: t for t in TABLES})
    joined = f"WITH {name} AS ({body})"
    rest = sql.strip()
    return f"{joined}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"{joined} {rest}"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
