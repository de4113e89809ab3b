from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewash.operators import decisions as G
from tidewash.plans import cleaning as plans
from tidewash.sources import csv, runs


def test_csv_keeps_quotes_breaks_and_spaces(spark, tmp_path):
    rows = [(1, 'say "hi", you', 1.5), (2, "two\nlines", None), (3, " padded ", 2.0), (4, None, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, t string, x double")
    path = str(tmp_path / "a.csv")
    csv.write_csv(df, path)
    assert sorted(map(tuple, csv.read_table(spark, path).collect())) == sorted(rows)
    assert csv.read_table(spark, path).dtypes == df.dtypes


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["1", " 2", "NA"], "bigint"),
        (["1", "2.5", "n/a"], "double"),
        (["inf", "1e3"], "double"),
        (["True", "False", "null"], "boolean"),
        (["1", "x"], "string"),
        (["1.5d"], "string"),
        (["1_000"], "string"),
        (["NA", "NaN"], "double"),
        (["99999999999999999999"], "double"),
    ],
)
def test_types(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    text = csv.tokens_to_null(df)
    assert csv.infer_types(text) == {"c": kind}
    assert csv.with_types(text, {"c": kind}).count() == len(values)


def test_plain_files_are_split(spark, tmp_path):
    one = tmp_path / "plain.csv"
    one.write_text('a,b\n1,"x, y"\n2,"say ""hi"""\n')
    got = csv.read_csv(spark, str(one)).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "x, y"), (2, 'say "hi"')]


def test_unknown_format_raises(spark):
    with pytest.raises(ValueError, match="xlsx"):
        csv.read_table(spark, "/data/a.xlsx")


def test_classified_copy(spark, tmp_path):
    assert csv.classified_path("/x/y.csv") == "/x/y_classified.csv"
    source = str(tmp_path / "s.csv")
    df = spark.createDataFrame([("a",)], "v string")
    csv.write_csv(df, source)
    target = csv.save_classified(df.withColumn("v_Classified", F.lit("k")), source)
    assert csv.read_table(spark, target).columns == ["v", "v_Classified"]
    assert csv.read_table(spark, source).columns == ["v"]


def dirty(spark):
    return spark.createDataFrame(
        [(i, f" S{i % 3} ", float(i % 7), None if i % 4 else 1.0) for i in range(40)],
        "Id int, Seg string, X double, Y double",
    )


def test_run_resumes_from_stored_steps(spark, tmp_path):
    run = runs.start_run(spark, str(tmp_path), "/in/data.csv", when=datetime(2024, 1, 2, 3, 4, 5))
    assert run.run_id == "data_20240102_030405"
    first = plans.clean_table(dirty(spark), 70, 70, run=run)
    assert run.is_done("clean") and run.is_done("profile_before") and run.is_done("profile_after")
    events = run.events().count()
    # A second call reads the stored output, whatever it is given.
    again = plans.clean_table(dirty(spark).limit(0), 70, 70, run=runs.Run(spark, str(tmp_path), run.run_id))
    assert again.data.count() == first.data.count() == 40
    assert run.events().count() == events
    assert run.read("input").count() == 40
    changes = again.reports["changes"].first()
    assert (changes["rows_before"], changes["cols_dropped_sparse"]) == (40, "y")


def test_unfinished_step_is_built_again(spark, tmp_path):
    run = runs.start_run(spark, str(tmp_path), "d.csv")
    built = []

    def build():
        built.append(1)
        return spark.range(3).toDF("id")

    run.step("s", build)
    run.step("s", build)
    assert len(built) == 1
    (tmp_path / "runs" / run.run_id / "s" / "_SUCCESS").unlink()
    assert run.step("s", build).count() == 3
    assert len(built) == 2


def test_registry_shows_the_last_status(spark, tmp_path):
    assert runs.run_registry(spark, str(tmp_path)).isEmpty()
    a = runs.start_run(spark, str(tmp_path), "a.csv")
    runs.start_run(spark, str(tmp_path), "b.csv")
    a.finish()
    got = {r["run_id"]: r["status"] for r in runs.run_registry(spark, str(tmp_path)).collect()}
    assert got[a.run_id] == "finished"
    assert sorted(got.values()) == ["finished", "in_progress"]


def test_full_cleaning_with_a_run(spark, tmp_path):
    run = runs.start_run(spark, str(tmp_path), "full.csv")
    done = plans.full_cleaning(
        dirty(spark),
        "id",
        outlier_names=["x"],
        review=lambda m: m,
        fills=plans.closest_fills("id", approved=True),
        run=run,
    )
    assert done.data.columns == ["id", "seg", "x"]
    assert done.data.where("seg is null or x is null").isEmpty()
    assert run.is_done("clean") and run.is_done("phase_3")
    for name in done.reports:
        done.reports[name].collect()
    assert "outlier_report" in done.reports and "missingness" in done.reports


def test_reports_without_a_run(spark):
    done = plans.clean_table(dirty(spark), 70, 70)
    assert list(done.reports) == [
        "summary_before", "correlation_before", "profile_before",
        "changes",
        "summary_after", "correlation_after", "profile_after",
    ]
    assert done.reports["changes"].first()["cols_dropped_sparse"] == "y"
    assert done.reports["summary_after"].first()["rows"] == 40
    treated = plans.treat_outliers(done.data, "id", ["x"])
    assert treated.reports["comparison"].first()["outliers_before"] == 0
    filled = plans.impute_table(
        dirty(spark), "Id", fills=plans.closest_fills("Id", approved=True)
    )
    assert filled.reports["missing_before"].where("missing_count > 0").count() == 1
    assert filled.reports["missing_after"].where("missing_count > 0").isEmpty()


ODD = ["price [usd]", "a/b", "x{y}", "q*"]


@pytest.mark.parametrize("stored", [False, True])
def test_jobs_with_odd_column_names(spark, tmp_path, stored):
    rows = [(i, *(None if i % 9 == k else float(i % 7) for k in range(3)), 1e6) for i in range(40)]
    rows.append((99, 1e9, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"`{c}` double" for c in ODD))

    def run(name):
        return runs.start_run(spark, str(tmp_path), f"{name} [1].csv") if stored else None

    held = plans.treat_outliers(df, "id", run=run("held"))
    assert held.data.count() == 41 and held.data.columns == df.columns
    decisions = G.approve(held.reports["decisions"])
    assert {r["column"] for r in decisions.collect()} >= {ODD[0]}
    done = plans.treat_outliers(df, "id", reviewed=decisions, run=run("done"))
    assert done.data.where("id = 99").isEmpty()
    waiting = plans.impute_table(df, "id", run=run("waiting"))
    assert waiting.data.where("`price [usd]` is null").count() == 5
    reviewed = G.approve(waiting.reports["fills"])
    filled = plans.impute_table(df, "id", reviewed=reviewed, run=run("filled"))
    for name in ODD:
        assert filled.data.where(f"`{name}` is null").isEmpty()


def test_a_held_run_goes_on_after_review(spark, tmp_path):
    rows = [(i, f"seg{i % 3}", None if i % 8 == 0 else float(i % 5)) for i in range(60)]
    rows.append((99, "odd one", 1e6))
    df = spark.createDataFrame(rows, "id long, seg string, x double")
    run = runs.start_run(spark, str(tmp_path), "gate.csv")
    held = plans.full_cleaning(df, "id", merge_names=["seg"], rare_below=3.0, run=run)
    assert held.data.count() == 61 and held.data.where("x is null").count() == 8
    assert [r["value"] for r in held.reports["rare"].collect()] == ["odd one"]
    review = plans.Reviewed(
        decisions=G.approve(held.reports["decisions"]),
        rare=G.approve(held.reports["rare"]),
        fills=G.approve(held.reports["fills"]),
    )
    done = plans.full_cleaning(
        df, "id", merge_names=["seg"], rare_below=3.0, reviewed=review, run=run
    )
    assert done.data.count() == 60 and done.data.where("x is null").isEmpty()
    kept = plans.full_cleaning(
        df, "id", merge_names=["seg"], reviewed=plans.Reviewed(rare=review.rare)
    )
    assert kept.data.where("seg = 'odd one'").isEmpty()
    assert kept.data.where("x is null").count() == 8
