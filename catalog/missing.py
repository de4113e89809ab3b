from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.inputs import union_all, view, with_view
from catalog.registry import query
from tidewash.operators import impute as I
from tidewash.operators import missing as M
from tidewash.operators.nearest import knn_features_fills
from tidewash.plans import cleaning as plans


@query(
    "null_patterns",
    with_view(
        "gappy_parts",
        """
SELECT concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN weight IS NULL THEN 'weight' END,
  CASE WHEN type IS NULL THEN 'type' END) AS pattern, count(*) AS "rows"
FROM gappy_parts GROUP BY 1""",
    ),
)
def null_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return M.null_patterns(view(spark, sf, "gappy_parts"))


@query(
    "null_rate_by_range",
    with_view(
        "docs_labelled",
        """
WITH e AS (SELECT min(doc_id)::DOUBLE AS low, max(doc_id)::DOUBLE AS high FROM docs_labelled),
b AS (SELECT least(floor((doc_id - low) / ((high - low) / 20)), 19)::BIGINT AS bucket, d.* FROM docs_labelled d, e),
"""
        + "t AS ("
        + union_all(
            [
                f"SELECT bucket, '{c}' AS \"column\", count(*) AS \"rows\", "
                f"count(*) - count({c}) AS missing FROM b GROUP BY bucket"
                for c in ("lang", "source", "n_chars", "quality", "toxic")
            ]
        )
        + ') SELECT *, round(missing::DOUBLE / "rows" * 100, 2) AS missing_pct FROM t',
    ),
)
def null_rate_by_range(spark: SparkSession, sf: str) -> DataFrame:
    return M.null_rate_by_range(view(spark, sf, "docs_labelled"), "doc_id", 20)


def chi2_sql(target: str, column: str, source: str) -> str:
    """Chi-squared of missing target against the values of a column."""
    return f"""
SELECT '{target}' AS target, '{column}' AS "column", 'categorical' AS type,
  (SELECT v FROM (SELECT {column} AS v, count(*) AS n FROM {source}
     WHERE {target} IS NULL AND {column} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)::VARCHAR AS dominant_val_missing,
  coalesce(round((SELECT max(n) * 100.0::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM {source}
     WHERE {target} IS NULL AND {column} IS NOT NULL GROUP BY {column})), 2), 0.0) AS dominant_pct_missing,
  (SELECT v FROM (SELECT {column} AS v, count(*) AS n FROM {source}
     WHERE {target} IS NOT NULL AND {column} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)::VARCHAR AS dominant_val_present,
  coalesce(round((SELECT max(n) * 100.0::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM {source}
     WHERE {target} IS NOT NULL AND {column} IS NOT NULL GROUP BY {column})), 2), 0.0) AS dominant_pct_present,
  NULL::DOUBLE AS mean_when_missing, NULL::DOUBLE AS median_when_missing,
  NULL::DOUBLE AS mean_when_present, NULL::VARCHAR AS direction,
  CASE WHEN dof = 0 THEN 0.0::DOUBLE ELSE stat END AS statistic, dof::BIGINT AS dof, NULL::DOUBLE AS z
FROM (SELECT sum(power(gap - CASE WHEN dof = 1 THEN least(0.5, gap) ELSE 0 END, 2) / e) AS stat, max(dof) AS dof
  FROM (SELECT abs(o - e) AS gap, e, dof FROM (
    SELECT coalesce(o.n, 0) AS o, fm.n * vm.n::DOUBLE / t.n AS e,
      ((SELECT count(*) FROM fl) - 1) * ((SELECT count(*) FROM vl) - 1) AS dof
    FROM fl fm CROSS JOIN vl vm CROSS JOIN (SELECT sum(n) AS n FROM fl) t
    LEFT JOIN cells o ON o.f = fm.f AND o.v = vm.v)))""".replace(
        "FROM (SELECT sum(power",
        f"""FROM (WITH cells AS (SELECT {target} IS NULL AS f, {column} AS v, count(*) AS n FROM {source}
    WHERE {column} IS NOT NULL GROUP BY 1, 2),
  fl AS (SELECT f, sum(n) AS n FROM cells GROUP BY f), vl AS (SELECT v, sum(n) AS n FROM cells GROUP BY v)
  SELECT sum(power""",
        1,
    )


def ranks_sql(target: str, column: str, source: str) -> str:
    """Mann-Whitney U of a column for missing against present target."""
    return f"""
SELECT '{target}' AS target, '{column}' AS "column", 'numerical' AS type,
  NULL::VARCHAR AS dominant_val_missing, NULL::DOUBLE AS dominant_pct_missing,
  NULL::VARCHAR AS dominant_val_present, NULL::DOUBLE AS dominant_pct_present,
  round(m1, 2) AS mean_when_missing, round(md, 2) AS median_when_missing,
  round(m2, 2) AS mean_when_present,
  CASE WHEN m1 > m2 THEN 'higher' ELSE 'lower' END AS direction, u AS statistic, NULL::BIGINT AS dof,
  (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5)
    / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z
FROM (SELECT sum(r) FILTER (WHERE f) - count(*) FILTER (WHERE f) * (count(*) FILTER (WHERE f) + 1) / 2.0::DOUBLE AS u,
    count(*) FILTER (WHERE f)::DOUBLE AS n1, count(*) FILTER (WHERE NOT f)::DOUBLE AS n2,
    avg(x) FILTER (WHERE f) AS m1, avg(x) FILTER (WHERE NOT f) AS m2,
    quantile_cont(x, 0.5) FILTER (WHERE f) AS md, sum(tie * tie - 1) AS ties
  FROM (SELECT x, f, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r,
      count(*) OVER (PARTITION BY x)::DOUBLE AS tie
    FROM (SELECT {column}::DOUBLE AS x, {target} IS NULL AS f FROM {source} WHERE {column} IS NOT NULL)))"""


CHI2_COLUMNS = 'target, "column", round(statistic, 6) AS statistic, dof'
BIASED = {
    "custkey": (["o_orderpriority", "status"], ["o_orderkey", "price"]),
    "status": (["o_orderpriority"], ["o_orderkey", "price", "custkey"]),
}


def biased_sql() -> str:
    parts = []
    for target, (texts, numbers) in BIASED.items():
        parts += [chi2_sql(target, c, "biased_orders") for c in texts]
        parts += [ranks_sql(target, c, "biased_orders") for c in numbers]
    return union_all([f"SELECT * FROM ({p})" for p in parts])


def profile(spark: SparkSession, sf: str, name: str = "biased_orders") -> DataFrame:
    return M.missingness_profile(view(spark, sf, name))


# The upper 5 % points of chi-squared for 2, 4 and 19 degrees of
# freedom, and the two-sided 5 % point of the normal law.
SIGNIFICANT = (
    "CASE WHEN type = 'numerical' THEN z > 1.959963984540054 "
    "WHEN dof = 2 THEN statistic > 5.991464547107979 "
    "WHEN dof = 4 THEN statistic > 9.487729036781154 "
    "WHEN dof = 19 THEN statistic > 30.14352720564616 ELSE false END"
)


@query(
    "missingness_chi2",
    with_view(
        "docs_labelled",
        f"SELECT {CHI2_COLUMNS} FROM ("
        + union_all(
            [
                f"SELECT * FROM ({chi2_sql(t, c, 'docs_labelled')})"
                for t, c in (
                    ("quality", "lang"), ("quality", "source"), ("quality", "toxic"),
                    ("toxic", "lang"), ("toxic", "source"), ("toxic", "quality"),
                )
            ]
        )
        + ")",
    ),
)
def missingness_chi2(spark: SparkSession, sf: str) -> DataFrame:
    found = profile(spark, sf, "docs_labelled").where("type = 'categorical'")
    return found.select("target", "column", F.round("statistic", 6).alias("statistic"), "dof")


@query(
    "missingness_mannwhitney",
    with_view(
        "biased_orders",
        'SELECT target, "column", mean_when_missing, median_when_missing, mean_when_present, '
        "direction, statistic FROM ("
        + union_all(
            [
                f"SELECT * FROM ({ranks_sql(t, c, 'biased_orders')})"
                for t, (_, numbers) in BIASED.items()
                for c in numbers
            ]
        )
        + ")",
    ),
)
def missingness_mannwhitney(spark: SparkSession, sf: str) -> DataFrame:
    return profile(spark, sf).where("type = 'numerical'").select(
        "target",
        "column",
        "mean_when_missing",
        "median_when_missing",
        "mean_when_present",
        "direction",
        "statistic",
    )


@query(
    "missingness_profile",
    with_view(
        "biased_orders",
        f"SELECT * EXCLUDE (statistic, z), round(statistic, 6) AS statistic, "
        f"{SIGNIFICANT} AS significant FROM ({biased_sql()})",
    ),
)
def missingness_profile(spark: SparkSession, sf: str) -> DataFrame:
    # p-values are checked in the tests; the checking SQL lacks their functions.
    found = profile(spark, sf).drop("raw_p", "p_value")
    return found.withColumn("statistic", F.round("statistic", 6))


@query(
    "missingness_drivers",
    with_view(
        "biased_orders",
        f"""
WITH p AS (SELECT *, {SIGNIFICANT} AS significant FROM ({biased_sql()})),
t AS (SELECT target, count(*) FILTER (WHERE significant) AS significant_drivers,
  count(*) AS total_tested FROM p GROUP BY target)
SELECT target, "column", type, significant_drivers, total_tested,
  round(significant_drivers::DOUBLE / total_tested, 3) AS signal_ratio
FROM p JOIN t USING (target) WHERE significant AND significant_drivers >= 1""",
    ),
)
def missingness_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return M.missingness_drivers(profile(spark, sf)).select(
        "target", "column", "type", "significant_drivers", "total_tested", "signal_ratio"
    )


# ---- filling --------------------------------------------------------------------


@query(
    "impute_bounds_numeric",
    with_view(
        "gappy_parts",
        union_all(
            [
                f"""
SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
  round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS lower,
  round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS upper,
  count(*) - count({c}) AS total_missing FROM gappy_parts"""
                for c in ("price", "weight")
            ]
        ),
    ),
)
def impute_bounds_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return I.bounds_numeric(view(spark, sf, "gappy_parts"), ["price", "weight"])


@query(
    "impute_bounds_categorical",
    with_view(
        "gappy_parts",
        """
WITH v AS (SELECT type AS value, count(*) AS count FROM gappy_parts WHERE type IS NOT NULL GROUP BY type),
t AS (SELECT sum(count)::DOUBLE AS n, max(count) AS top FROM v)
SELECT 'type' AS "column", value, count, round(count / n, 4) AS share,
  (SELECT value FROM v ORDER BY count DESC, value LIMIT 1) AS dominant_value,
  round(top * 100.0::DOUBLE / n, 2) AS dominant_pct,
  (SELECT count(*) - count(type) FROM gappy_parts) AS total_missing
FROM v, t""",
    ),
)
def impute_bounds_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return I.bounds_categorical(view(spark, sf, "gappy_parts"), ["type"])


NEAR = """
p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos,
  count(totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM gappy_orders),
have AS (SELECT pos, k, totalprice AS v FROM p WHERE totalprice IS NOT NULL),
need AS (SELECT o_orderkey AS row_id, pos, k, row_number() OVER (ORDER BY pos) AS idx FROM p WHERE totalprice IS NULL),
cand AS (SELECT n.row_id, n.idx, abs(h.pos - n.pos) AS distance, h.v, row_number() OVER (
    PARTITION BY n.row_id ORDER BY abs(h.pos - n.pos), h.pos) AS place
  FROM need n CROSS JOIN generate_series(-4, 5) s(d) JOIN have h ON h.k = n.k + s.d),
near AS (SELECT * FROM cand WHERE place <= 5)"""


@query(
    "nearest_neighbours",
    with_view(
        "gappy_orders",
        f'WITH {NEAR} SELECT row_id, idx AS "index", place::INTEGER AS place, '
        "distance::BIGINT AS distance, v AS value FROM near",
    ),
)
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    near = I.nearest_neighbours(view(spark, sf, "gappy_orders"), "totalprice", "o_orderkey")
    return near.select("row_id", "index", F.posexplode("neighbours").alias("place", "n")).select(
        "row_id",
        "index",
        (F.col("place") + 1).alias("place"),
        F.col("n.distance").alias("distance"),
        F.col("n.value").alias("value"),
    )


@query(
    "impute_records",
    with_view(
        "gappy_orders",
        f"""
WITH {NEAR}, c AS (SELECT row_id, idx, round(sum(v), 2) AS neighbour_sum, count(*) AS neighbours
  FROM near GROUP BY row_id, idx)
SELECT 'totalprice' AS "column", idx AS "index", (SELECT count(*) FROM need) AS total, row_id, o_custkey,
  o_orderpriority, neighbours::INTEGER AS neighbours, neighbour_sum, '' AS drivers
FROM c JOIN gappy_orders ON row_id = o_orderkey""",
    ),
)
def impute_records(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "gappy_orders")
    found = I.impute_records(orders, "totalprice", "o_orderkey")
    total = F.aggregate("closest_neighbours", F.lit(0.0), lambda a, v: a + v)
    return found.withColumns(
        {"neighbours": F.size("closest_neighbours"), "neighbour_sum": F.round(total, 2)}
    ).drop("closest_neighbours")


def _number(fills: DataFrame) -> DataFrame:
    value: Column = F.round(F.col("value").cast("double"), 4)
    return fills.select("row_id", "column", value.alias("value"), "approved")


def _neighbour_sql(value: str) -> str:
    return with_view(
        "gappy_orders",
        f"WITH {NEAR} SELECT row_id, 'totalprice' AS \"column\", round({value}, 4) AS value, "
        "false AS approved FROM near GROUP BY row_id",
    )


@query("impute_neighbours", _neighbour_sql("avg(v)"))
def impute_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _number(I.neighbour_fills(view(spark, sf, "gappy_orders"), "totalprice", "o_orderkey"))


@query("impute_neighbours_median", _neighbour_sql("quantile_cont(v, 0.5)"))
def impute_neighbours_median(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "gappy_orders")
    return _number(I.neighbour_fills(orders, "totalprice", "o_orderkey", "median"))


def _group_sql(value: str) -> str:
    return with_view(
        "gappy_orders",
        f"""
WITH g AS (SELECT o_orderpriority, {value} AS v FROM gappy_orders GROUP BY o_orderpriority)
SELECT o_orderkey AS row_id, 'totalprice' AS "column", round(v, 4) AS value, false AS approved
FROM gappy_orders JOIN g USING (o_orderpriority) WHERE totalprice IS NULL""",
    )


@query("impute_group_mean", _group_sql("avg(totalprice)"))
def impute_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "gappy_orders")
    return _number(I.group_fills(orders, "totalprice", "o_orderkey", "o_orderpriority"))


@query("impute_group_median", _group_sql("quantile_cont(totalprice, 0.5)"))
def impute_group_median(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "gappy_orders")
    return _number(
        I.group_fills(orders, "totalprice", "o_orderkey", "o_orderpriority", "median")
    )


@query(
    "impute_group_mode",
    with_view(
        "gappy_parts",
        """
WITH c AS (SELECT size, type, count(*) AS n FROM gappy_parts WHERE type IS NOT NULL GROUP BY ALL),
m AS (SELECT size, type, row_number() OVER (PARTITION BY size ORDER BY n DESC, type) AS r FROM c)
SELECT p.id AS row_id, 'type' AS "column", m.type AS value, 'mode by size' AS reason, false AS approved
FROM gappy_parts p JOIN m ON p.size = m.size AND r = 1 WHERE p.type IS NULL""",
    ),
)
def impute_group_mode(spark: SparkSession, sf: str) -> DataFrame:
    return I.group_fills(view(spark, sf, "gappy_parts"), "type", "id", "size", "mode")


@query(
    "impute_function",
    with_view(
        "gappy_orders",
        f"WITH {NEAR} SELECT row_id, 'totalprice' AS \"column\", round(max(v), 4) AS value, "
        "false AS approved FROM near GROUP BY row_id",
    ),
)
def impute_function(spark: SparkSession, sf: str) -> DataFrame:
    records = I.impute_records(view(spark, sf, "gappy_orders"), "totalprice", "o_orderkey")

    def choose(batch):
        return batch.assign(value=batch["closest_neighbours"].map(max), reason="largest")

    return _number(I.fills_by_function(records, choose))


@query(
    "apply_fills",
    with_view(
        "gappy_orders",
        """
SELECT o_orderkey, o_custkey, o_orderpriority,
  coalesce(totalprice, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey + 0.5
    WHEN o_orderkey % 4 = 2 THEN o_orderkey * 10.0 END)::DOUBLE AS totalprice
FROM gappy_orders""",
    ),
)
def apply_fills(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "gappy_orders")
    key, turn = F.col("o_orderkey"), F.col("o_orderkey") % 4
    # A reviewer's table: good values, text that is no number, and one not approved.
    value = (
        F.when(turn == 0, F.lit("unknown"))
        .when(turn == 1, F.concat(key.cast("string"), F.lit(".5")))
        .when(turn == 2, F.concat(key.cast("string"), F.lit("e1")))
        .otherwise(F.lit("7"))
    )
    fills = orders.where("totalprice IS NULL").select(
        key.alias("row_id"),
        F.lit("totalprice").alias("column"),
        value.alias("value"),
        F.lit("reviewed").alias("reason"),
        (turn != 3).alias("approved"),
    )
    return I.apply_fills(orders, fills, "totalprice", "o_orderkey")


@query(
    "impute_statistical",
    with_view(
        "gappy_parts",
        """
WITH s AS (SELECT avg(price) AS mp, quantile_cont(price, 0.5) AS dp, avg(weight) AS mw,
  quantile_cont(weight, 0.5) AS dw, avg(power(price, 3)) AS p3, avg(power(weight, 3)) AS w3 FROM gappy_parts),
k AS (SELECT s.*, (SELECT avg(power(price - mp, 3)) / power(var_pop(price), 1.5) FROM gappy_parts, s) AS sp,
  (SELECT avg(power(weight - mw, 3)) / power(var_pop(weight), 1.5) FROM gappy_parts, s) AS sw FROM s)
SELECT id, size, round(coalesce(price, CASE WHEN abs(sp) > 1 THEN dp ELSE mp END), 4) AS price,
  round(coalesce(weight, CASE WHEN abs(sw) > 1 THEN dw ELSE mw END), 4) AS weight,
  coalesce(type, (SELECT type FROM gappy_parts WHERE type IS NOT NULL GROUP BY type
    ORDER BY count(*) DESC, type LIMIT 1)) AS type
FROM gappy_parts, k""",
    ),
)
def impute_statistical(spark: SparkSession, sf: str) -> DataFrame:
    filled = I.impute_statistical(view(spark, sf, "gappy_parts"))
    return filled.withColumns({c: F.round(c, 4) for c in ("price", "weight")})


def _order_mean(target: str, source: str, prefix: str) -> str:
    """CTEs that fill a column with the mean of the five closest rows."""
    return f"""
{prefix}p AS (SELECT *, row_number() OVER (ORDER BY id) AS pos,
  count({target}) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS k FROM {source}),
{prefix}h AS (SELECT pos, k, {target} AS v FROM {prefix}p WHERE {target} IS NOT NULL),
{prefix}c AS (SELECT n.id, h.v, row_number() OVER (PARTITION BY n.id ORDER BY abs(h.pos - n.pos), h.pos) AS r
  FROM {prefix}p n CROSS JOIN generate_series(-4, 5) s(d) JOIN {prefix}h h ON h.k = n.k + s.d
  WHERE n.{target} IS NULL)"""


MEAN_PRICE = "SELECT id, avg(v) AS v FROM pc WHERE r <= 5 GROUP BY id"
MEAN_WEIGHT = "SELECT id, avg(v) AS v FROM wc WHERE r <= 5 GROUP BY id"
MODE_TYPE = """SELECT id, arg_min(v, lpad((10 - n)::VARCHAR, 3, '0') || v) AS v
  FROM (SELECT id, v, count(*) AS n FROM tc WHERE r <= 5 GROUP BY id, v) GROUP BY id"""


@query(
    "impute_sequential",
    with_view(
        "gappy_parts",
        f"""
WITH {_order_mean('price', 'gappy_parts', 'p')}, {_order_mean('weight', 'gappy_parts', 'w')}
SELECT g.id, size, round(coalesce(price, a.v), 4) AS price, round(coalesce(weight, b.v), 4) AS weight, type
FROM gappy_parts g LEFT JOIN ({MEAN_PRICE}) a ON a.id = g.id LEFT JOIN ({MEAN_WEIGHT}) b ON b.id = g.id""",
    ),
)
def impute_sequential(spark: SparkSession, sf: str) -> DataFrame:
    parts = view(spark, sf, "gappy_parts")
    filled = I.impute_sequential(
        parts,
        "id",
        lambda current, name: I.neighbour_fills(current, name, "id", approved=True),
        exclude=["type"],
    )
    return filled.withColumns({c: F.round(c, 4) for c in ("price", "weight")})


@query(
    "impute_table",
    with_view(
        "gappy_parts",
        f"""
WITH {_order_mean('price', 'gappy_parts', 'p')}, {_order_mean('weight', 'gappy_parts', 'w')},
{_order_mean('type', 'gappy_parts', 't')}
SELECT g.id, size, round(coalesce(price, a.v), 4) AS price, round(coalesce(weight, b.v), 4) AS weight,
  coalesce(type, t.v) AS type
FROM gappy_parts g LEFT JOIN ({MEAN_PRICE}) a ON a.id = g.id LEFT JOIN ({MEAN_WEIGHT}) b ON b.id = g.id
LEFT JOIN ({MODE_TYPE}) t ON t.id = g.id""",
    ),
)
def impute_table(spark: SparkSession, sf: str) -> DataFrame:
    parts = view(spark, sf, "gappy_parts")
    filled = plans.impute_table(parts, "id", fills=plans.closest_fills("id", approved=True)).data
    return filled.withColumns({c: F.round(c, 4) for c in ("price", "weight")})


@query("impute_table_held", with_view("gappy_parts", "SELECT * FROM gappy_parts"))
def impute_table_held(spark: SparkSession, sf: str) -> DataFrame:
    """Without a reviewer the fills wait and the table stays as it is."""
    return plans.impute_table(view(spark, sf, "gappy_parts"), "id").data


@query(
    "impute_knn",
    with_view(
        "gappy_orders",
        """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS pos
  FROM gappy_orders),
c AS (SELECT n.o_orderkey AS row_id, d.totalprice AS v, row_number() OVER (PARTITION BY n.o_orderkey
    ORDER BY abs(d.o_custkey - n.o_custkey), abs(d.pos - n.pos), d.pos) AS r
  FROM p n JOIN p d ON n.o_orderpriority = d.o_orderpriority AND n.totalprice IS NULL
    AND d.totalprice IS NOT NULL)
SELECT row_id, 'totalprice' AS "column", round(avg(v), 4) AS value, false AS approved
FROM c WHERE r <= 5 GROUP BY row_id""",
    ),
)
def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "gappy_orders")
    return _number(
        I.knn_fills(orders, "totalprice", "o_custkey", "o_orderkey", "o_orderpriority")
    )


@query(
    "impute_knn_features",
    with_view(
        "gappy_parts",
        """
WITH m AS (SELECT avg(id) AS mi, stddev_pop(id) AS si, avg(size) AS ms, stddev_pop(size) AS ss FROM gappy_parts),
z AS (SELECT id, (id - mi) / si AS a, (size - ms) / ss AS b, weight FROM gappy_parts, m),
c AS (SELECT n.id AS row_id, d.weight AS v, row_number() OVER (PARTITION BY n.id
    ORDER BY round((n.a - d.a) * (n.a - d.a) + (n.b - d.b) * (n.b - d.b), 9), d.id) AS r
  FROM z n JOIN z d ON n.weight IS NULL AND d.weight IS NOT NULL)
SELECT row_id, 'weight' AS "column", round(avg(v), 4) AS value, false AS approved
FROM c WHERE r <= 5 GROUP BY row_id""",
    ),
)
def impute_knn_features(spark: SparkSession, sf: str) -> DataFrame:
    parts = view(spark, sf, "gappy_parts")
    return _number(knn_features_fills(parts, "weight", ["id", "size"], "id"))


def _regression_round(i: int) -> str:
    """One round: price on weight, then weight on the new price."""
    last = f"r{i - 1}"
    return f"""
a{i} AS (SELECT regr_slope(price, weight) AS s, regr_intercept(price, weight) AS b FROM {last} WHERE NOT gp),
x{i} AS (SELECT id, CASE WHEN gp THEN b + s * weight ELSE price END AS price, weight, gp, gw FROM {last}, a{i}),
b{i} AS (SELECT regr_slope(weight, price) AS s, regr_intercept(weight, price) AS b FROM x{i} WHERE NOT gw),
r{i} AS (SELECT id, price, CASE WHEN gw THEN b + s * price ELSE weight END AS weight, gp, gw FROM x{i}, b{i})"""


@query(
    "impute_iterative",
    with_view(
        "gappy_parts",
        f"""
WITH r0 AS (SELECT id, coalesce(price, (SELECT avg(price) FROM gappy_parts)) AS price,
  coalesce(weight, (SELECT avg(weight) FROM gappy_parts)) AS weight,
  price IS NULL AS gp, weight IS NULL AS gw FROM gappy_parts),
{', '.join(_regression_round(i) for i in range(1, 4))}
SELECT g.id, g.size, round(r.price, 4) AS price, round(r.weight, 4) AS weight, g.type
FROM gappy_parts g JOIN r3 r ON g.id = r.id""",
    ),
)
def impute_iterative(spark: SparkSession, sf: str) -> DataFrame:
    filled = I.impute_iterative(
        view(spark, sf, "gappy_parts"), "id", ["price", "weight"], rounds=3
    )
    return filled.withColumns({c: F.round(c, 4) for c in ("price", "weight")})


@query(
    "impute_by_driver",
    with_view(
        "gappy_parts",
        """
WITH pair AS (SELECT type, size, avg(weight) AS v FROM gappy_parts WHERE weight IS NOT NULL AND type IS NOT NULL
  AND size IS NOT NULL GROUP BY type, size),
one AS (SELECT type, avg(weight) AS v FROM gappy_parts WHERE weight IS NOT NULL AND type IS NOT NULL GROUP BY type),
w AS (SELECT avg(weight) AS v FROM gappy_parts)
SELECT g.id AS row_id, 'weight' AS "column", round(coalesce(pair.v, one.v, w.v), 4) AS value,
  CASE WHEN pair.v IS NOT NULL THEN 'mean by type and size' WHEN one.v IS NOT NULL THEN 'mean by type'
    ELSE 'mean of the column' END AS reason, false AS approved
FROM gappy_parts g CROSS JOIN w LEFT JOIN pair ON pair.type = g.type AND pair.size = g.size
LEFT JOIN one ON one.type = g.type WHERE g.weight IS NULL""",
    ),
)
def impute_by_driver(spark: SparkSession, sf: str) -> DataFrame:
    """Filled from rows that agree in two columns, else in one, else from all."""
    fills = I.driver_fills(view(spark, sf, "gappy_parts"), "weight", "id", ["type", "size"])
    return fills.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(
    "impute_by_driver_mode",
    with_view(
        "gappy_parts",
        """
WITH pair AS (SELECT size, price, type AS v, row_number() OVER (PARTITION BY size, price ORDER BY count(*) DESC, type) AS r
  FROM gappy_parts WHERE type IS NOT NULL AND size IS NOT NULL AND price IS NOT NULL GROUP BY size, price, type),
one AS (SELECT size, type AS v, row_number() OVER (PARTITION BY size ORDER BY count(*) DESC, type) AS r
  FROM gappy_parts WHERE type IS NOT NULL AND size IS NOT NULL GROUP BY size, type),
w AS (SELECT type AS v FROM gappy_parts WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)
SELECT g.id AS row_id, 'type' AS "column", coalesce(pair.v, one.v, w.v) AS value, false AS approved
FROM gappy_parts g CROSS JOIN w LEFT JOIN pair ON pair.size = g.size AND pair.price = g.price AND pair.r = 1
LEFT JOIN one ON one.size = g.size AND one.r = 1 WHERE g.type IS NULL""",
    ),
)
def impute_by_driver_mode(spark: SparkSession, sf: str) -> DataFrame:
    fills = I.driver_fills(
        view(spark, sf, "gappy_parts"), "type", "id", ["size", "price"], "mode"
    )
    return fills.drop("reason")
