from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import table, view, with_view
from catalog.registry import query
from tidewash.operators import label as L
from tidewash.plans import cleaning as plans

RULES = [("bolt|gear|rod", "hardware"), ("^(red|blue)", "coloured"), ("g", "with g")]
CASES = """CASE WHEN regexp_matches(p_name, 'bolt|gear|rod') THEN 'hardware'
  WHEN regexp_matches(p_name, '^(red|blue)') THEN 'coloured'
  WHEN regexp_matches(p_name, 'g') THEN 'with g' ELSE 'other' END"""


@query(
    "distinct_atomic_values",
    with_view(
        "dirty_lists",
        "SELECT DISTINCT trim(unnest(string_split(tags, ','))) AS value FROM dirty_lists",
    ),
)
def distinct_atomic_values(spark: SparkSession, sf: str) -> DataFrame:
    return L.distinct_atomic_values(view(spark, sf, "dirty_lists"), "tags")


@query("label_by_rules", f'SELECT *, {CASES} AS "p_name_Classified" FROM part')
def label_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_by_rules(table(spark, sf, "part"), "p_name", RULES, "other")


@query(
    "label_by_lookup",
    """
SELECT c.*, r.r_name AS "c_mktsegment_Classified" FROM customer c LEFT JOIN (
  SELECT s, r_name FROM (SELECT c_mktsegment AS s, min(c_nationkey % 5) AS k FROM customer
    WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1) JOIN region ON k = r_regionkey) r ON r.s = c.c_mktsegment""",
)
def label_by_lookup(spark: SparkSession, sf: str) -> DataFrame:
    customer, region = table(spark, sf, "customer"), table(spark, sf, "region")
    lookup = (
        customer.where("c_mktsegment <> 'MACHINERY'")
        .groupBy(F.col("c_mktsegment").alias("value"))
        .agg(F.min(F.col("c_nationkey") % 5).alias("k"))
        .join(region, F.col("k") == F.col("r_regionkey"))
        .select("value", F.col("r_name").alias("label"))
    )
    return L.label_by_lookup(customer, "c_mktsegment", lookup)


@query(
    "label_by_function",
    'SELECT *, upper(p_name[1:3]) AS "p_name_Classified" FROM part',
)
def label_by_function(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_by_function(
        table(spark, sf, "part"), "p_name", lambda values: values.str[:3].str.upper()
    )


@query(
    "label_counts",
    f"SELECT {CASES} AS label, count(*) AS count FROM part GROUP BY 1",
)
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    labelled = L.label_by_rules(table(spark, sf, "part"), "p_name", RULES, "other")
    return L.label_counts(labelled, "p_name_Classified")


@query(
    "label_frequency_topn",
    "SELECT p_name AS label, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def label_frequency_topn(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_counts(table(spark, sf, "part"), "p_name", 10)


@query(
    "label_table",
    f"SELECT {CASES} AS label, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def label_table(spark: SparkSession, sf: str) -> DataFrame:
    done = plans.label_table(table(spark, sf, "part"), "p_name", RULES, "other", top_n=3)
    return done.reports["counts"]
