from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import table, view, with_view
from catalog.registry import query
from tidewash.functions.columns import column_kinds, numeric_columns
from tidewash.functions.frequencies import distinct_counts
from tidewash.functions.scratch import scratch_folder
from tidewash.functions.text import slug, to_number
from tidewash.operators import clean as C
from tidewash.operators.decisions import approve, beyond, decide_by_rule
from tidewash.operators.label import label_by_rules
from tidewash.operators.merge import distinct_normalized_values
from tidewash.operators.outliers import outlier_summary
from tidewash.plans import cleaning as plans
from tidewash.sources import csv, runs

NORMAL = """
normal AS (SELECT custkey, lower(trim(segment)) AS segment, acctbal,
  lower(trim(sparse_note)) AS sparse_note, nationkey FROM dirty_customer),
uniq AS (SELECT DISTINCT * FROM normal)
"""
EMPTIES = """(CASE WHEN custkey IS NULL THEN 1 ELSE 0 END
  + CASE WHEN segment IS NULL OR trim(segment) = '' THEN 1 ELSE 0 END
  + CASE WHEN acctbal IS NULL THEN 1 ELSE 0 END
  + CASE WHEN sparse_note IS NULL OR trim(sparse_note) = '' THEN 1 ELSE 0 END
  + CASE WHEN nationkey IS NULL THEN 1 ELSE 0 END)"""


@query(
    "normalize_headers",
    "SELECT c_custkey AS cust_key, c_name AS full_name, c_nationkey AS nation, "
    "c_acctbal AS account_balance, c_mktsegment AS segment FROM customer",
)
def normalize_headers(spark: SparkSession, sf: str) -> DataFrame:
    messy = table(spark, sf, "customer").toDF(
        " Cust Key", "Full Name ", "NATION", "Account Balance", "\tSegment"
    )
    return C.normalize_headers(messy)


@query(
    "normalize_text",
    with_view("dirty_customer", f"WITH {NORMAL} SELECT * FROM normal"),
)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalize_text(view(spark, sf, "dirty_customer"))


@query(
    "changed_columns",
    with_view(
        "dirty_customer",
        """
SELECT * FROM (
  SELECT 'segment' AS "column", count(*) FILTER (WHERE lower(trim(segment)) IS DISTINCT FROM segment)
    AS changed_rows FROM dirty_customer
  UNION ALL
  SELECT 'sparse_note', count(*) FILTER (WHERE lower(trim(sparse_note)) IS DISTINCT FROM sparse_note)
    FROM dirty_customer) WHERE changed_rows > 0""",
    ),
)
def changed_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.changed_text_columns(view(spark, sf, "dirty_customer"))


@query(
    "blank_to_null",
    with_view(
        "dirty_customer",
        "SELECT custkey, CASE WHEN trim(segment) <> '' THEN segment END AS segment, acctbal, "
        "CASE WHEN trim(sparse_note) <> '' THEN sparse_note END AS sparse_note, nationkey "
        "FROM dirty_customer",
    ),
)
def blank_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return C.blank_to_null(view(spark, sf, "dirty_customer"))


@query("drop_duplicates", with_view("dirty_customer", f"WITH {NORMAL} SELECT * FROM uniq"))
def drop_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_duplicates(C.normalize_text(view(spark, sf, "dirty_customer")))


@query(
    "duplicate_stats",
    with_view(
        "dirty_customer",
        """
SELECT count(*) AS total_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)))
    * 100.0::DOUBLE / count(*), 2) AS duplicate_pct
FROM dirty_customer""",
    ),
)
def duplicate_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_stats(view(spark, sf, "dirty_customer"))


@query(
    "drop_sparse_rows",
    with_view(
        "dirty_customer",
        f"SELECT * FROM dirty_customer WHERE NOT ({EMPTIES} / 5.0 * 100 > 70)",
    ),
)
def drop_sparse_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_sparse_rows(view(spark, sf, "dirty_customer"))


@query(
    "drop_sparse_columns",
    with_view("dirty_customer", "SELECT custkey, segment, acctbal, nationkey FROM dirty_customer"),
)
def drop_sparse_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_sparse_columns(view(spark, sf, "dirty_customer"))


@query(
    "empty_cells",
    with_view(
        "dirty_customer",
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {test}) AS empty_count, "
            f"round(count(*) FILTER (WHERE {test}) * 100.0::DOUBLE / count(*), 4) AS empty_pct "
            "FROM dirty_customer"
            for c, test in {
                "custkey": "custkey IS NULL",
                "segment": "segment IS NULL OR trim(segment) = ''",
                "acctbal": "acctbal IS NULL",
                "sparse_note": "sparse_note IS NULL OR trim(sparse_note) = ''",
                "nationkey": "nationkey IS NULL",
            }.items()
        ),
    ),
)
def empty_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = C.empty_cells(view(spark, sf, "dirty_customer"))
    return cells.withColumn("empty_pct", F.round("empty_pct", 4))


@query(
    "cleaning_diagnostics",
    with_view(
        "dirty_customer",
        f"""
WITH t AS (SELECT *, {EMPTIES} / 5.0 * 100 > 70 AS sparse FROM dirty_customer),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty_customer)),
a AS (SELECT count(*) AS "rows", count(*) FILTER (WHERE sparse) AS sparse_row_count,
  count(*) FILTER (WHERE custkey IS NULL) AS e1,
  count(*) FILTER (WHERE segment IS NULL OR trim(segment) = '') AS e2,
  count(*) FILTER (WHERE acctbal IS NULL) AS e3,
  count(*) FILTER (WHERE sparse_note IS NULL OR trim(sparse_note) = '') AS e4,
  count(*) FILTER (WHERE nationkey IS NULL) AS e5 FROM t)
SELECT "rows", 5::BIGINT AS cols, "rows" - n AS duplicate_count,
  round(("rows" - n) * 100.0::DOUBLE / "rows", 2) AS duplicate_pct,
  sparse_row_count, round(sparse_row_count * 100.0::DOUBLE / "rows", 2) AS sparse_row_pct,
  concat_ws(',', CASE WHEN e1 * 100.0 / "rows" > 70 THEN 'custkey' END,
    CASE WHEN e2 * 100.0 / "rows" > 70 THEN 'segment' END,
    CASE WHEN e3 * 100.0 / "rows" > 70 THEN 'acctbal' END,
    CASE WHEN e4 * 100.0 / "rows" > 70 THEN 'sparse_note' END,
    CASE WHEN e5 * 100.0 / "rows" > 70 THEN 'nationkey' END) AS sparse_cols
FROM a, d""",
    ),
)
def cleaning_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return C.cleaning_diagnostics(view(spark, sf, "dirty_customer"))


KEPT = f"kept AS (SELECT * FROM uniq WHERE NOT ({EMPTIES} / 5.0 * 100 > 70))"


@query(
    "cleaning_summary",
    with_view(
        "dirty_customer",
        f"""
WITH {NORMAL}, {KEPT}
SELECT (SELECT count(*) FROM dirty_customer) AS rows_before,
  (SELECT count(*) FROM kept) AS rows_after, 5::BIGINT AS cols_before, 4::BIGINT AS cols_after,
  (SELECT count(*) FROM dirty_customer) - (SELECT count(*) FROM uniq) AS duplicates_removed,
  (SELECT count(*) FROM uniq) - (SELECT count(*) FROM kept) AS rows_dropped_sparse,
  'sparse_note' AS cols_dropped_sparse, '' AS headers_normalised,
  'segment,sparse_note' AS categorical_normalised""",
    ),
)
def cleaning_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(view(spark, sf, "dirty_customer")).summary()


CLEANED = "SELECT custkey, nullif(segment, '') AS segment, acctbal, nationkey FROM kept"


@query("clean_table", with_view("dirty_customer", f"WITH {NORMAL}, {KEPT} {CLEANED}"))
def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    return plans.clean_table(view(spark, sf, "dirty_customer")).data


@query(
    "slugify",
    r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text,
  chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)
  ||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)
  ||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)
  ||chr(8287)||chr(12288))),
  '[^\p{L}\p{M}\p{N}_\s\x{A0}\x{2028}\x{2029}-]', '', 'g'), '[\s\x{A0}\x{2028}\x{2029}-]+', '_', 'g'), '_') AS slug
FROM documents""",
)
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", slug(F.col("text")).alias("slug"))


@query(
    "coerce_numeric",
    """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN CAST(user_id AS DOUBLE)
  WHEN 1 THEN 1000.0 + 100 + user_id % 900 WHEN 3 THEN -100.0 * user_id
  WHEN 4 THEN CAST('inf' AS DOUBLE) WHEN 8 THEN user_id + 0.25 ELSE NULL END::DOUBLE AS number
FROM events""",
)
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    texts = view(spark, sf, "number_texts")
    # Adding zero turns -0.0 into 0.0.
    return texts.select("event_id", (to_number(F.col("written")) + F.lit(0.0)).alias("number"))


@query(
    "distinct_normalized_values",
    with_view(
        "typo_parts",
        "SELECT DISTINCT lower(trim(name)) AS value FROM typo_parts WHERE trim(name) <> ''",
    ),
)
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_normalized_values(view(spark, sf, "typo_parts"), "name")


@query(
    "csv_roundtrip",
    "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}.csv"
    csv.write_csv(table(spark, sf, "documents"), path)
    return csv.read_table(spark, path)


@query(
    "na_tokens_typed",
    """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust,
  CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price,
  o_orderkey % 3 = 0 AS late,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM orders""",
)
def na_tokens_typed(spark: SparkSession, sf: str) -> DataFrame:
    text = csv.tokens_to_null(view(spark, sf, "typed_orders"))
    return csv.with_types(text, csv.infer_types(text))


@query(
    "report_roundtrip",
    """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT 'value' AS "column", 'before' AS stage, count(*) AS total_rows,
  count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outlier_count,
  round(count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
    * 100.0::DOUBLE / count(*), 2) AS outlier_pct
FROM events, q""",
)
def report_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/report-{uuid.uuid4().hex}"
    report = outlier_summary(table(spark, sf, "events"), ["value"])
    csv.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("run_snapshot", "SELECT * FROM orders")
def run_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The raw input, kept by a run: a later, changed input does not replace it."""
    run = runs.start_run(spark, scratch_folder(spark), f"orders [{uuid.uuid4().hex}].csv")
    run.snapshot_input(table(spark, sf, "orders"))
    return run.snapshot_input(table(spark, sf, "orders").where("false"))


@query(
    "run_steps_resume",
    """
SELECT step, count(*) AS events, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS rows_left
FROM (VALUES ('input'), ('kept [o_totalprice > 100000]')) v(step) GROUP BY step""",
)
def run_steps_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Steps with any name are done once; a resumed run reads their outputs."""
    run = runs.start_run(spark, scratch_folder(spark), f"steps-{uuid.uuid4().hex}.csv")
    name = "kept [o_totalprice > 100000]"
    for wanted in (100_000, 0):  # the second round finds both steps done
        raw = run.snapshot_input(table(spark, sf, "orders"))
        kept = run.step(name, lambda raw=raw, wanted=wanted: raw.where(F.col("o_totalprice") > wanted))
    done = run.events().where(F.col("status") == runs.DONE)
    return done.groupBy("step").agg(F.count("*").alias("events")).withColumn(
        "rows_left", F.lit(kept.count()).cast("bigint")
    )


@query(
    "classified_export",
    """
SELECT *, CASE WHEN regexp_matches(p_name, 'ring') THEN 'ring' ELSE 'other' END AS "p_name_Classified"
FROM part""",
)
def classified_export(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled copy beside the source, read back."""
    source = f"{scratch_folder(spark)}/part-{uuid.uuid4().hex}.parquet"
    labelled = label_by_rules(table(spark, sf, "part"), "p_name", [("ring", "ring")], "other")
    return csv.read_table(spark, csv.save_classified(labelled, source))


@query(
    "column_selection",
    """
SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
    WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'datetime' END AS kind,
  column_type IN ('BIGINT', 'DOUBLE') AS narrow,
  CASE column_name """
    + " ".join(
        f"WHEN '{c}' THEN (SELECT count(DISTINCT {c}) FROM lineitem)"
        for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        )
    )
    + " END AS num_unique FROM (DESCRIBE lineitem)",
)
def column_selection(spark: SparkSession, sf: str) -> DataFrame:
    """How each column counts, under the wide and the narrow rule, and its distinct values."""
    lines = table(spark, sf, "lineitem")
    kinds, narrow = column_kinds(lines), numeric_columns(lines, "narrow")
    rows = [(c, kinds[c], c in narrow) for c in lines.columns]
    listed = spark.createDataFrame(rows, "column string, kind string, narrow boolean")
    return listed.join(distinct_counts(lines, lines.columns).drop("present"), "column")


@query("drop_named_columns", "SELECT event_id, ts, event_type, value FROM events")
def drop_named_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_columns(table(spark, sf, "events"), ["user_id", "props", "absent"])


@query(
    "cleaning_defaults",
    with_view("dirty_customer", f"WITH {NORMAL}, {KEPT} SELECT count(*) AS rows_left FROM kept"),
)
def cleaning_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """The rows left without any threshold given: 70 percent for rows and columns."""
    return C.clean(view(spark, sf, "dirty_customer")).data.agg(F.count("*").alias("rows_left"))


@query(
    "run_registry_latest",
    """
SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS started_at,
  arg_max(CASE event_type WHEN 'error' THEN 'failed' ELSE 'in_progress' END,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || event_type) AS status,
  arg_max(event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || event_type) AS last_step,
  count(*) AS events
FROM events GROUP BY user_id""",
)
def run_registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        "ts",
        F.col("event_type").alias("step"),
        F.when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("in_progress"))
        .alias("status"),
    )
    return runs.latest_status(steps)


FULL = with_view(
    "dirty_customer",
    f"""
WITH {NORMAL}, {KEPT}, c AS ({CLEANED}),
q1 AS (SELECT quantile_cont(acctbal, 0.25) a, quantile_cont(acctbal, 0.75) b FROM c),
c1 AS (SELECT c.* FROM c, q1 WHERE NOT coalesce(acctbal > b + 3 * (b - a) OR acctbal < a - 3 * (b - a), false)),
p AS (SELECT *, row_number() OVER (ORDER BY custkey) AS pos FROM c1),
s_have AS (SELECT pos, segment, row_number() OVER (ORDER BY pos) AS k FROM p WHERE segment IS NOT NULL),
s_need AS (SELECT p.pos, p.custkey, (SELECT count(*) FROM s_have h WHERE h.pos < p.pos) AS k FROM p
  WHERE segment IS NULL),
s_near AS (SELECT n.custkey, h.segment AS v, row_number() OVER (PARTITION BY n.custkey
    ORDER BY abs(h.pos - n.pos), h.pos) AS r
  FROM s_need n JOIN s_have h ON h.k BETWEEN n.k - 4 AND n.k + 5),
s_votes AS (SELECT custkey, v, count(*) AS n FROM s_near WHERE r <= 5 GROUP BY ALL),
s_fill AS (SELECT custkey, arg_min(v, lpad(CAST(10 - n AS VARCHAR), 3, '0') || v) AS v FROM s_votes GROUP BY custkey),
a_have AS (SELECT pos, acctbal, row_number() OVER (ORDER BY pos) AS k FROM p WHERE acctbal IS NOT NULL),
a_need AS (SELECT p.pos, p.custkey, (SELECT count(*) FROM a_have h WHERE h.pos < p.pos) AS k FROM p
  WHERE acctbal IS NULL),
a_near AS (SELECT n.custkey, h.acctbal AS v, row_number() OVER (PARTITION BY n.custkey
    ORDER BY abs(h.pos - n.pos), h.pos) AS r
  FROM a_need n JOIN a_have h ON h.k BETWEEN n.k - 4 AND n.k + 5),
a_fill AS (SELECT custkey, avg(v) AS v FROM a_near WHERE r <= 5 GROUP BY custkey)
SELECT p.custkey, coalesce(p.segment, s.v) AS segment, round(coalesce(p.acctbal, a.v), 4) AS acctbal, p.nationkey
FROM p LEFT JOIN s_fill s ON p.custkey = s.custkey LEFT JOIN a_fill a ON p.custkey = a.custkey""",
)


@query("full_cleaning", FULL)
def full_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """All columns, with the approvals of a reviewer."""
    done = plans.full_cleaning(
        view(spark, sf, "dirty_customer"),
        "custkey",
        decide=lambda records: approve(decide_by_rule(records, beyond(3.0), "beyond three IQR")),
        review=approve,
        fills=plans.closest_fills("custkey", approved=True),
    )
    return done.data.withColumn("acctbal", F.round("acctbal", 4))


@query(
    "full_cleaning_held",
    with_view(
        "dirty_customer",
        f"""
WITH {NORMAL}, {KEPT}, c AS ({CLEANED}) SELECT custkey, segment, acctbal, nationkey FROM c""",
    ),
)
def full_cleaning_held(spark: SparkSession, sf: str) -> DataFrame:
    """Without a reviewer the cleaned table comes back and the proposals wait."""
    return plans.full_cleaning(view(spark, sf, "dirty_customer"), "custkey").data
