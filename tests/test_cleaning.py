import pytest
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.operators import cleaning as C
from tideline.sources.checks import WriteChecks
from tideline.sources.profiles import read_profiles, row_count, write_clean


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "customerID string, `Senior_Citizen ` int, tenure int, Total_Charges string, Plan string"
    )


def test_headers_are_trimmed(spark):
    df = C.trim_headers(raw(spark, [("a", 1, 2, "3", "x")]))
    assert df.columns == ["customerID", "Senior_Citizen", "tenure", "Total_Charges", "Plan"]


def test_colliding_headers_are_refused(spark):
    with pytest.raises(ValueError, match="collide"):
        C.trim_headers(spark.createDataFrame([(1, 2)], "`a ` int, a int"))


def test_shape_is_asserted(spark):
    df = raw(spark, [("a", 1, 2, "3", "x")])
    assert C.expect_shape(df, 1, 5) is df
    with pytest.raises(ValueError, match="unexpected shape"):
        C.expect_shape(df, 2, 5)


def test_missing_identifier_is_refused(spark):
    with pytest.raises(ValueError, match="missing required column"):
        C.drop_identifier(spark.range(1))
    with pytest.raises(ValueError, match="missing required column"):
        read_profiles(spark, df=spark.range(1))


def test_all_outer_whitespace_goes_and_sentinels_stay(spark):
    df = spark.createDataFrame(
        [("\t Yes\n",), ("No internet service",), (" No ",), (" a  b ",), (None,)], "s string"
    )
    found = [r.s for r in C.trim_strings(df).collect()]
    assert found == ["Yes", "No internet service", "No", "a  b", None]


def test_blank_counts_nulls_and_whitespace(spark):
    df = spark.createDataFrame([(" ", 1.0), (None, None), ("x", 2.0), ("\t\n", 3.0)], "s string, n double")
    row = C.count_blank(df, ["s", "n"]).first()
    assert (row["blank_s"], row["blank_n"]) == (3, 1)


def test_blank_total_becomes_zero_only_under_the_guard(spark):
    df = raw(spark, [("a", 0, 0, " ", "x"), ("b", 0, 3, " 9.5 ", "x"), ("c", 0, 0, "4", "x")])
    for check in (True, False):
        out = C.coerce_numeric_with_rule(df, "Total_Charges", F.col("tenure") == 0, check=check)
        assert [r["Total_Charges"] for r in out.collect()] == [0.0, 9.5, 4.0]


@pytest.mark.parametrize("check", [True, False])
def test_blank_total_outside_the_guard_raises(spark, check):
    df = raw(spark, [("a", 0, 5, None, "x")])
    with pytest.raises(Exception, match="blank-row rule"):
        C.coerce_numeric_with_rule(
            df, "Total_Charges", F.col("tenure") == 0, check=check
        ).collect()


def test_text_that_is_no_number_raises(spark):
    df = raw(spark, [("a", 0, 5, "many", "x")])
    with pytest.raises(Exception, match="no number"):
        C.coerce_numeric_with_rule(df, "Total_Charges", F.col("tenure") == 0).collect()


def test_numeric_null_counts_as_blank(spark):
    df = spark.createDataFrame([(0, None), (2, 8.0)], "tenure int, Total_Charges double")
    out = C.coerce_numeric_with_rule(df, "Total_Charges", F.col("tenure") == 0)
    assert [r["Total_Charges"] for r in out.collect()] == [0.0, 8.0]


def test_ratio_has_four_decimals_and_is_null_at_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (3, 10.0)], "tenure int, Total_Charges double")
    assert [r[V.RATIO] for r in C.ratio_feature(df).collect()] == [None, 3.3333]


def test_menu_violations_name_the_cell(spark):
    df = spark.createDataFrame(
        [("k1", "Two year", True), ("k2", "Forever", False), ("k3", None, None)],
        "customerID string, Contract string, Senior_Citizen boolean",
    )
    assert [tuple(r) for r in C.menu_violations(df, "customerID").collect()] == [
        ("k2", "Contract", "Forever")
    ]


def test_mapping_needs_the_label_and_reports_what_is_missing(spark):
    df = spark.createDataFrame([(1, "Yes", 9)], "months int, gone string, other int")
    mapped, missing = C.map_schema(df, {"months": "tenure", "gone": "Churn"}, ["tenure", "Contract"])
    assert mapped.columns == ["tenure", "Churn"] and missing == ["Contract"]
    with pytest.raises(ValueError, match="Churn"):
        C.map_schema(df, {"months": "tenure"}, ["tenure"])


def test_label_is_one_for_yes_only(spark):
    df = C.binarize_label(spark.createDataFrame([("Yes",), ("No",), (None,), ("yes",)], "Churn string"))
    assert [r.label for r in df.collect()] == [1, 0, 0, 0]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_written_copy_reads_back(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", " x "), ("b", "\ty")], "customerID string, s string")
    path = write_clean(df, str(tmp_path / f"copy.{kind}"), kind=kind)
    write_clean(df, path, kind=kind)  # overwrites
    back = read_profiles(spark, path, shape=(2, 2))
    assert sorted(map(tuple, back.collect())) == [("a", " x "), ("b", "\ty")]
    assert tuple(row_count(back).first()) == (2, 2)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_text_that_is_no_number_raises_with_and_without_ansi(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("abc", 1), (" 2.5 ", 2)], "total string, tenure int")
        guard = F.col("tenure") == 0
        bad = C.coerce_numeric_with_rule(df, "total", guard, check=False)
        with pytest.raises(Exception, match="no number"):
            bad.collect()
        good = C.coerce_numeric_with_rule(df.where("tenure = 2"), "total", guard)
        assert good.first()["total"] == 2.5
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def checked(spark, rows, path, expected_rows, checks):
    df = spark.createDataFrame(rows, "tenure int, Total_Charges string")
    df = C.expect_shape(df, expected_rows, 2, checks=checks)
    df = C.coerce_numeric_with_rule(df, "Total_Charges", F.col("tenure") == 0, checks=checks)
    return write_clean(df, path, checks=checks)


GOOD = [(0, " "), (3, "4.5"), (2, " 7 "), (0, "1")]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_checks_hold_in_the_write_job(spark, tmp_path, kind):
    checks = WriteChecks()
    df = C.expect_shape(spark.createDataFrame(GOOD, "a int, b string"), 4, 2, checks=checks)
    path = write_clean(df, str(tmp_path / f"t.{kind}"), kind=kind, checks=checks)
    assert checks.found == {"rows": 4}
    reader = spark.read.option("header", True)
    assert {(int(r.a), r.b) for r in reader.format(kind).load(path).collect()} == set(GOOD)
    assert [p.name for p in tmp_path.iterdir()] == [f"t.{kind}"]


def test_a_checked_write_runs_one_job_and_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    checked(spark, [(1, "9")], path, 1, WriteChecks())
    tracker, group = spark.sparkContext.statusTracker(), "one-checked-write"
    spark.sparkContext.setJobGroup(group, group)
    try:
        checks = WriteChecks()
        checked(spark, GOOD, path, 4, checks)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) == 1
    assert checks.found == {"rows": 4, "Total_Charges blank": 0, "Total_Charges text": 0}
    assert sorted(r.Total_Charges for r in spark.read.parquet(path).collect()) == [0.0, 1.0, 4.5, 7.0]


@pytest.mark.parametrize(
    "rows, expected, said",
    [
        (GOOD, 5, "unexpected number of rows 4, expected 5"),
        ([*GOOD, (2, ""), (None, None)], 6, "2 blank Total_Charges row"),
        ([*GOOD, (2, "x"), (0, "y")], 6, "2 Total_Charges text"),
        ([], 1, "unexpected number of rows 0, expected 1"),
        ([(2, " "), (2, "x")], 1, "rows 2, expected 1; 1 blank .*; 1 Total_Charges text"),
    ],
)
def test_a_failed_check_leaves_what_was_there(spark, tmp_path, rows, expected, said):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match=said):
        checked(spark, rows, path, expected, WriteChecks())
    assert list(tmp_path.iterdir()) == []
    checked(spark, [(1, "9")], path, 1, WriteChecks())
    with pytest.raises(ValueError, match=said):
        checked(spark, rows, path, expected, WriteChecks())
    assert [r.Total_Charges for r in spark.read.parquet(path).collect()] == [9.0]


def test_an_empty_table_passes_checks_for_none(spark, tmp_path):
    path = checked(spark, [], str(tmp_path / "t"), 0, WriteChecks())
    assert spark.read.parquet(path).count() == 0


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int").withColumn("b", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        write_clean(df, str(tmp_path / "t"), checks=WriteChecks())
    assert list(tmp_path.iterdir()) == []
