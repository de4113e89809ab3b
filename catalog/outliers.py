from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import table, union_all, view, with_view
from catalog.registry import query
from tidewash.operators import decisions as G
from tidewash.operators import density as D
from tidewash.operators import outliers as O
from tidewash.plans import cleaning as plans


def fences_sql(column: str, source: str, factor: float = 1.5) -> str:
    """One row ``q1, med, q3, lo, hi`` for a column."""
    return (
        f"SELECT q1, med, q3, q1 - {factor} * (q3 - q1) AS lo, q3 + {factor} * (q3 - q1) AS hi "
        f"FROM (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, "
        f"quantile_cont({column}::DOUBLE, 0.5) AS med, "
        f"quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source})"
    )


def summary_sql(columns: list[str], source: str, stage: str) -> str:
    return union_all(
        [
            f"""
SELECT '{c}' AS "column", count(*) AS total_rows,
  count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count, '{stage}' AS stage,
  round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 100.0::DOUBLE / count(*), 2) AS outlier_pct
FROM {source}, ({fences_sql(c, source)})"""
            for c in columns
        ]
    )


@query(
    "outlier_summary",
    with_view(
        "docs_labelled",
        summary_sql(["doc_id", "n_chars", "quality", "toxic"], "docs_labelled", "before"),
    ),
)
def outlier_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.outlier_summary(view(spark, sf, "docs_labelled"))


OUT = "outs AS (SELECT value FROM events, f WHERE value < lo OR value > hi)"


def density_sql(eps: str) -> str:
    """Density clusters of the outliers of events.value by range frames."""
    return f"""
WITH f AS ({fences_sql('value', 'events')}), {OUT},
s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM outs),
z AS (SELECT value, (value - m) / sd AS z, {eps} AS eps FROM outs, s, f),
c AS (SELECT *, (SELECT count(*) FROM z b WHERE b.z - a.z <= a.eps AND a.z - b.z <= a.eps) >= 3 AS core FROM z a),
k AS (SELECT DISTINCT z, eps FROM c WHERE core),
g AS (SELECT z, CASE WHEN z - lag(z) OVER (ORDER BY z) <= eps THEN 0 ELSE 1 END AS starts FROM k),
i AS (SELECT z, sum(starts) OVER (ORDER BY z) - 1 AS cluster FROM g),
n AS (SELECT DISTINCT c.z, c.eps FROM c WHERE NOT core),
b AS (SELECT n.z, i.cluster, row_number() OVER (PARTITION BY n.z ORDER BY abs(i.z - n.z), i.z) AS r
  FROM n JOIN i ON abs(i.z - n.z) <= n.eps),
l AS (SELECT z, cluster FROM i UNION ALL SELECT z, cluster FROM b WHERE r = 1),
a AS (SELECT c.value, c.core, l.cluster FROM c LEFT JOIN l ON c.z = l.z)"""


DENSITY_REPORT = """
SELECT 'value' AS "column", count(DISTINCT cluster) AS n_clusters,
  count(*) FILTER (WHERE cluster IS NULL) AS noise_points,
  round(count(*) FILTER (WHERE cluster IS NULL) * 100.0::DOUBLE / count(*), 2) AS noise_pct,
  count(*) FILTER (WHERE core) AS core_points FROM a"""
AUTO_EPS = "greatest(0.3, 0.5 * w / CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END)"


@query(
    "numeric_outlier_report",
    density_sql(AUTO_EPS)
    + f""", d AS ({DENSITY_REPORT}),
r AS (SELECT 'value' AS "column", avg(value) AS mean, min(q1) AS q1, min(q3) AS q3, min(lo) AS lo, min(hi) AS hi,
  (SELECT value FROM events GROUP BY value ORDER BY count(*) DESC, value LIMIT 1) AS mode,
  count(value) AS n, count(*) FILTER (WHERE value < lo OR value > hi) AS o FROM events, f)
SELECT "column", round(mean, 4) AS mean, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(lo, 4) AS lower_fence, round(hi, 4) AS upper_fence, round(mode, 4) AS mode,
  n AS n_total, o AS n_outliers, round(o * 100.0::DOUBLE / n, 2) AS outlier_pct,
  n_clusters, noise_points, noise_pct FROM r JOIN d USING ("column")"""
    + "".join(
        f"""
UNION ALL SELECT '{c}', round(avg({c}), 4), round(min(z.q1), 4), round(min(z.q3), 4), round(min(z.q3 - z.q1), 4),
  round(min(z.lo), 4), round(min(z.hi), 4),
  (SELECT {c}::DOUBLE FROM events GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1),
  count({c}), count(*) FILTER (WHERE {c} < z.lo OR {c} > z.hi),
  round(count(*) FILTER (WHERE {c} < z.lo OR {c} > z.hi) * 100.0::DOUBLE / count({c}), 2), NULL, NULL, NULL
FROM events, ({fences_sql(c, 'events')}) z"""
        for c in ("event_id", "user_id")
    ),
)
def numeric_outlier_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every numeric column; the two without outliers have no clusters."""
    return D.numeric_outlier_report(table(spark, sf, "events"))


@query("outlier_dbscan_1d", density_sql("0.05") + DENSITY_REPORT)
def outlier_dbscan_1d(spark: SparkSession, sf: str) -> DataFrame:
    return D.density_report(D.outlier_clusters(table(spark, sf, "events"), ["value"], eps=0.05))


@query(
    "outlier_noise_removed",
    density_sql(AUTO_EPS)
    + """, noise AS (SELECT DISTINCT value FROM a WHERE cluster IS NULL)
SELECT * FROM events WHERE value IS NULL OR value NOT IN (SELECT value FROM noise)""",
)
def outlier_noise_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Only outliers that no cluster has are removed."""
    done = plans.treat_outliers(
        table(spark, sf, "events"),
        "event_id",
        ["value"],
        decide=lambda records: G.approve(G.decide_by_rule(records, F.col("noise"), "noise")),
        density=True,
    )
    return done.data


@query(
    "outlier_dbscan_sizes",
    density_sql("0.05")
    + ' SELECT \'value\' AS "column", cluster::BIGINT AS cluster, count(*) AS points '
    "FROM a WHERE cluster IS NOT NULL GROUP BY cluster",
)
def outlier_dbscan_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return D.cluster_sizes(D.outlier_clusters(table(spark, sf, "events"), ["value"], eps=0.05))


@query(
    "iqr_outlier_rows",
    f"""
SELECT e.*, CASE WHEN value > hi THEN 'ABOVE upper fence' ELSE 'BELOW lower fence' END AS direction
FROM events e, ({fences_sql('value', 'events')}) WHERE value < lo OR value > hi""",
)
def iqr_outlier_rows(spark: SparkSession, sf: str) -> DataFrame:
    return O.iqr_outlier_rows(table(spark, sf, "events"), "value")


@query(
    "boxplot_stats",
    with_view(
        "docs_labelled",
        union_all(
            [
                f"""
SELECT '{c}' AS "column", round(min(q1), 4) AS q1, round(min(med), 4) AS median,
  round(min(q3), 4) AS q3,
  min({c}::DOUBLE) FILTER (WHERE {c} >= lo AND {c} <= hi) AS whisker_low,
  max({c}::DOUBLE) FILTER (WHERE {c} >= lo AND {c} <= hi) AS whisker_high,
  count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS fliers
FROM docs_labelled, ({fences_sql(c, 'docs_labelled')})"""
                for c in ("doc_id", "n_chars", "quality", "toxic")
            ]
        ),
    ),
)
def boxplot_stats(spark: SparkSession, sf: str) -> DataFrame:
    return O.boxplot_stats(view(spark, sf, "docs_labelled"))


@query(
    "winsorize_iqr",
    with_view(
        "docs_labelled",
        f"""
SELECT doc_id, lang, source, round(least(greatest(n_chars::DOUBLE, a.lo), a.hi), 6) AS n_chars,
  CASE WHEN quality IS NOT NULL THEN least(greatest(quality::DOUBLE, b.lo), b.hi) END AS quality, toxic
FROM docs_labelled, ({fences_sql('n_chars', 'docs_labelled')}) a,
  ({fences_sql('quality', 'docs_labelled')}) b""",
    ),
)
def winsorize_iqr(spark: SparkSession, sf: str) -> DataFrame:
    capped = O.winsorize(view(spark, sf, "docs_labelled"), ["n_chars", "quality"])
    return capped.withColumn("n_chars", F.round("n_chars", 6))


RECORDS = f"""
WITH f AS ({fences_sql('value', 'events')}),
o AS (SELECT event_id AS row_id, value, user_id::DOUBLE AS with_user_id FROM events, f
  WHERE value < lo OR value > hi),
records AS (SELECT 'value' AS "column", row_number() OVER (ORDER BY row_id) AS "index",
  (SELECT count(*) FROM o) AS total, row_id,
  CASE WHEN value > hi THEN 'ABOVE upper fence' ELSE 'BELOW lower fence' END AS direction,
  value, with_user_id, round((SELECT avg(value) FROM events), 4) AS mean, round(med, 4) AS median,
  round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 4) AS lower, round(hi, 4) AS upper
  FROM o, f)"""
REMOVED = "(value > q3 + 3 * (q3 - q1) OR value < q1 - 3 * (q3 - q1))"


@query("outlier_records", f"{RECORDS} SELECT * FROM records")
def outlier_records(spark: SparkSession, sf: str) -> DataFrame:
    return O.outlier_records(table(spark, sf, "events"), "value", "event_id")


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    records = O.outlier_records(table(spark, sf, "events"), "value", "event_id")
    return G.decide_by_rule(records, G.beyond(3.0), "beyond three IQR")


@query(
    "outlier_decisions_rule",
    f"""{RECORDS} SELECT row_id, "column", CASE WHEN {REMOVED} THEN 'remove' ELSE 'keep' END AS action,
CASE WHEN {REMOVED} THEN 'beyond three IQR' ELSE 'within the rule' END AS reason, false AS approved
FROM records""",
)
def outlier_decisions_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf)


@query(
    "outlier_decisions_function",
    f"""{RECORDS} SELECT row_id, "column",
CASE WHEN with_user_id < 75 THEN 'remove' ELSE 'keep' END AS action,
direction AS reason, false AS approved FROM records""",
)
def outlier_decisions_function(spark: SparkSession, sf: str) -> DataFrame:
    records = O.outlier_records(table(spark, sf, "events"), "value", "event_id")

    def decide(batch):
        action = batch["with_user_id"].lt(75).map({True: "remove", False: "keep"})
        return batch.assign(action=action, reason=batch["direction"])

    return G.decide_by_function(records, decide)


@query(
    "apply_outlier_decisions",
    f"{RECORDS} SELECT * FROM events WHERE event_id NOT IN "
    f"(SELECT row_id FROM records WHERE {REMOVED})",
)
def apply_outlier_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decided = G.approve(_decisions(spark, sf))
    return G.apply_decisions(table(spark, sf, "events"), decided, "event_id")


@query(
    "apply_approved_only",
    f"{RECORDS} SELECT * FROM events WHERE event_id NOT IN "
    f"(SELECT row_id FROM records WHERE {REMOVED} AND row_id % 2 = 0)",
)
def apply_approved_only(spark: SparkSession, sf: str) -> DataFrame:
    decided = G.approve(_decisions(spark, sf), F.col("row_id") % 2 == 0)
    return G.apply_decisions(table(spark, sf, "events"), decided, "event_id")


SEQUENTIAL = f"""
WITH f1 AS ({fences_sql('n_chars', 'docs_labelled')}),
s1 AS (SELECT d.* FROM docs_labelled d, f1 WHERE NOT coalesce(n_chars < lo OR n_chars > hi, false)),
f2 AS ({fences_sql('quality', 's1')}),
s2 AS (SELECT s1.* FROM s1, f2 WHERE NOT coalesce(quality < lo OR quality > hi, false)),
f3 AS ({fences_sql('toxic', 's2')}),
s3 AS (SELECT s2.* FROM s2, f3 WHERE NOT coalesce(toxic < lo OR toxic > hi, false))"""


@query("sequential_iqr_removal", with_view("docs_labelled", f"{SEQUENTIAL} SELECT * FROM s3"))
def sequential_iqr_removal(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "docs_labelled")
    return O.remove_outliers(docs, ["n_chars", "quality", "toxic"]).data


@query(
    "single_pass_iqr_removal",
    with_view(
        "docs_labelled",
        "SELECT d.* FROM docs_labelled d, "
        + ", ".join(
            f"({fences_sql(c, 'docs_labelled')}) {a}"
            for a, c in (("x", "n_chars"), ("y", "quality"), ("z", "toxic"))
        )
        + " WHERE "
        + " AND ".join(
            f"NOT coalesce({c} < {a}.lo OR {c} > {a}.hi, false)"
            for a, c in (("x", "n_chars"), ("y", "quality"), ("z", "toxic"))
        ),
    ),
)
def single_pass_iqr_removal(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "docs_labelled")
    return O.remove_outliers(docs, ["n_chars", "quality", "toxic"], sequential=False).data


@query(
    "outlier_comparison",
    with_view(
        "docs_labelled",
        SEQUENTIAL
        + f""", b AS ({summary_sql(['n_chars', 'quality', 'toxic'], 'docs_labelled', 'before')}),
a AS ({summary_sql(['n_chars', 'quality', 'toxic'], 's3', 'after')})
SELECT b."column", b.outlier_count AS outliers_before, a.outlier_count AS outliers_after,
  b.outlier_count - a.outlier_count AS outliers_removed,
  CASE WHEN b.outlier_count = 0 THEN 0.0::DOUBLE ELSE
    round((b.outlier_count - a.outlier_count) * 100.0::DOUBLE / b.outlier_count, 2) END AS pct_reduced
FROM b JOIN a ON a."column" = b."column" """,
    ),
)
def outlier_comparison(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = view(spark, sf, "docs_labelled"), ["n_chars", "quality", "toxic"]
    left = O.remove_outliers(docs, names).data
    return O.outlier_comparison(
        O.outlier_summary(docs, names, "before"), O.outlier_summary(left, names, "after")
    )


def remove_beyond(records: DataFrame) -> DataFrame:
    """The reviewer of the queries: what lies beyond three IQR goes."""
    return G.approve(G.decide_by_rule(records, G.beyond(3.0), "beyond three IQR"))


BEYOND = "coalesce({c} > f.q3 + 3 * (f.q3 - f.q1) OR {c} < f.q1 - 3 * (f.q3 - f.q1), false)"


@query(
    "outlier_treatment",
    with_view(
        "docs_labelled",
        f"""
WITH f1 AS ({fences_sql('n_chars', 'docs_labelled')}),
s1 AS (SELECT d.* FROM docs_labelled d, f1 f WHERE NOT {BEYOND.format(c='n_chars')}),
f2 AS ({fences_sql('quality', 's1')})
SELECT s1.* FROM s1, f2 f WHERE NOT {BEYOND.format(c='quality')}""",
    ),
)
def outlier_treatment(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "docs_labelled")
    return plans.treat_outliers(docs, "doc_id", ["n_chars", "quality"], remove_beyond).data


@query("outlier_treatment_held", with_view("docs_labelled", "SELECT * FROM docs_labelled"))
def outlier_treatment_held(spark: SparkSession, sf: str) -> DataFrame:
    """Without a reviewer the proposals wait and the table stays as it is."""
    docs = view(spark, sf, "docs_labelled")
    return plans.treat_outliers(docs, "doc_id", ["n_chars", "quality"]).data


@query(
    "outlier_capping",
    with_view(
        "docs_labelled",
        f"""
WITH f AS ({fences_sql('n_chars', 'docs_labelled')}), g AS ({fences_sql('quality', 'docs_labelled')})
SELECT doc_id, lang, source, round(CASE WHEN n_chars > f.hi THEN f.hi WHEN n_chars < f.lo THEN f.lo
    ELSE n_chars::DOUBLE END, 6) AS n_chars,
  CASE WHEN quality > g.hi THEN g.hi WHEN quality < g.lo THEN g.lo ELSE quality::DOUBLE END AS quality,
  toxic FROM docs_labelled, f, g""",
    ),
)
def outlier_capping(spark: SparkSession, sf: str) -> DataFrame:
    """Every outlier is proposed for capping, reviewed, and capped in a second call."""
    docs, names = view(spark, sf, "docs_labelled"), ["n_chars", "quality"]
    held = plans.treat_outliers(docs, "doc_id", names, rule=F.lit(True), action="cap")
    done = plans.treat_outliers(
        docs, "doc_id", names, reviewed=G.approve(held.reports["decisions"])
    )
    return done.data.withColumn("n_chars", F.round("n_chars", 6))


ORDER_TOTALS = """
SELECT l_orderkey AS order_id, count(*) AS lines, max(l_quantity) AS quantity, max(l_discount) AS discount,
  max(l_tax) AS tax, max(l_suppkey) AS supplier, max(l_partkey) AS part, max(l_orderkey * 3) AS triple,
  max(l_extendedprice) * CASE WHEN l_orderkey % 50 = 0 THEN 9 ELSE 1 END AS price
FROM {lineitem} GROUP BY l_orderkey"""
RELATED = ("lines", "quantity", "discount", "tax", "supplier", "part", "triple")


@query(
    "outlier_records_lineitem",
    f"""
WITH v AS ({ORDER_TOTALS.format(lineitem='lineitem')}),
f AS ({fences_sql('price', 'v')}),
near AS (SELECT {', '.join(f"abs(corr(price, {c})) AS {c}" for c in RELATED)} FROM v),
ranked AS (SELECT name FROM (UNPIVOT near ON COLUMNS(*) INTO NAME name VALUE r)
  ORDER BY r DESC, name LIMIT 5)
SELECT order_id AS row_id, 'price' AS "column", count(*) OVER () AS total,
  row_number() OVER (ORDER BY order_id) AS "index", round(price, 2) AS value,
  (SELECT string_agg(name, ',' ORDER BY name) FROM ranked) AS related
FROM v, f WHERE price < lo OR price > hi""",
)
def outlier_records_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Five related columns, none of them the key, although a column goes with it."""
    orders = spark.sql(ORDER_TOTALS, lineitem=table(spark, sf, "lineitem"))
    records = O.outlier_records(orders, "price", "order_id")
    related = sorted(c.removeprefix("with_") for c in records.columns if c.startswith("with_"))
    return records.select(
        "row_id",
        "column",
        "total",
        "index",
        F.round("value", 2).alias("value"),
        F.lit(",".join(related)).alias("related"),
    )
