"""Input that must not be lost or misread silently: quoted feeds, headerless files, NaN, nulls."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis, coercion, extensions, profile, render, sessions, trace
from plumbline.sources.delimited import load_table, read_delimited


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quoted_line_feeds_need_no_option(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\n1,"two\nlines"\n2,x\n')
    (folder / "b.csv").write_text('k,v\n3,"one"\n4,y\n')
    got = rows(load_table(spark, str(folder)).df)
    assert got == [(1, "two\nlines"), (2, "x"), (3, "one"), (4, "y")]


def test_headerless_files_keep_their_first_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("3,z\n")
    got = load_table(spark, str(tmp_path), names=["a", "b"], header=False)
    assert rows(got.df) == [(1, "x"), (2, "y"), (3, "z")]
    assert load_table(spark, str(tmp_path / "a.csv"), header=False).df.columns == ["column_1", "column_2"]


def test_code_page_rows_that_look_like_the_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,é€\nk,v\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("k,v\n2,x\n".encode("cp1252"))
    got = read_delimited(spark, str(tmp_path), ["k", "v"], encoding="CP1252")
    assert rows(got) == [("1", "é€"), ("2", "x"), ("k", "v")]
    (tmp_path / "b.csv").write_bytes(b"v,k\n2,x\n")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path), ["k", "v"], encoding="cp1252")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path), ["k", "v"], encoding="utf-16-le")


def test_encodings_by_any_spelling(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"a\nb"\n')
    got = read_delimited(spark, str(tmp_path), ["k", "v"], encoding="UTF8", multiline=True)
    assert rows(got) == [("1", "a\nb")]


def test_samples_of_tied_rows(spark):
    df = spark.createDataFrame([(1, v) for v in range(200, 0, -1)], "k int, v int")
    got = {r["name"]: r["sample"] for r in profile.column_samples(df, ["k"]).collect()}
    assert got == {"k": ["1", "1", "1"], "v": ["1", "10", "100"]}


def test_texts_that_look_like_digests_count_apart(spark):
    texts = ["x" * 200, "\0" + "0" * 64, "\0d" + "0" * 64, "\0", "\0t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert profile.column_profile(df).first()["unique"] == 5


NAN = float("nan")


def test_measures_that_are_not_numbers(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", NAN, NAN), ("b", 3.0, 6.0), ("b", None, 1.0), ("b", 2.0, 4.0)],
        "k string, v double, w double",
    )
    assert rows(analysis.breakdown(df, "k", "v", "w")) == [("a", 1.0, 2), ("b", 5.0, 11)]
    assert rows(extensions.correlations(df)) == [("v", "w", pytest.approx(1.0))]
    assert extensions.correlations(df.select("k", "v")).collect() == []
    assert rows(extensions.histogram(df, "v", 2)) == [(0, 1), (1, 2)]
    assert extensions.outliers(df, "v", 0.0).where("isnan(v)").count() == 0
    assert rows(analysis.chart_series(df, "k", "v")) == [("a", 1.0), ("b", 5.0)]


def test_growth_is_from_month_to_month(spark):
    day = datetime.date
    df = spark.createDataFrame(
        [(day(2025, 1, 5), "x", 10.0), (day(2025, 2, 5), "x", 15.0), (day(2025, 4, 1), "x", 30.0),
         (day(2025, 5, 1), "x", 0.0), (day(2025, 6, 1), "x", 7.0)],
        "d date, k string, v double",
    )
    got = {r["month"].month: r["growth"] for r in extensions.growth(df, "d", "v", "k").collect()}
    assert got == {1: None, 2: 0.5, 4: None, 5: -1.0, 6: None}


def test_key_overlap_of_many_columns(spark):
    columns = {f"c{i}": spark.range(i, i + 3).selectExpr(f"id AS c{i}") for i in range(70)}
    got = extensions.key_overlap(columns)
    assert got.count() == 70 * 69
    shared = {r["right_column"]: r["shared_values"] for r in got.where("left_column = 'c5'").collect()}
    assert (shared["c4"], shared["c6"], shared["c7"], shared["c8"]) == (2, 2, 1, 0)


def test_null_sessions_and_keys(spark):
    log = spark.createDataFrame(
        [(None, 1, "k", "old", False), (None, 2, None, None, True), (None, 3, "k", "new", False),
         (None, 4, None, "v", False), ("s", 1, None, "v", False)],
        "s string, n long, k string, v string, clear boolean",
    )
    latest = sessions.latest_values(log, "s", "n", "k", "v", log["clear"])
    assert rows(latest) == sorted([(None, "k", "new", 3), (None, None, "v", 4), ("s", None, "v", 1)], key=repr)
    assert rows(sessions.state_documents(latest)) == sorted([(None, '{"k":"new"}'), ("s", "{}")], key=repr)
    never = F.lit(None).cast("boolean")
    assert trace.recorded_events(log.select("s", "n"), "s", "n", never, F.lit(False)).count() == 5


def test_missing_deviation_is_printed_as_nan(spark):
    one = spark.createDataFrame([(1.0,)], "v double")
    text = "\n".join(r["line"] for r in render.analysis_report_lines(one).collect())
    assert "std=nan" in text


@pytest.mark.parametrize(
    "text, want",
    [
        ("2025-01-02T10:00:00Z", (2025, 1, 2, 10)),
        ("2025-01-02 10:00:00+02:00", (2025, 1, 2, 8)),
        ("2025-01-02T10:30-0530", (2025, 1, 2, 16, 0)),
        ("2025-01-02T10:00:00.123456789", (2025, 1, 2, 10, 0, 0, 123456)),
        ("01-Jan-2025", (2025, 1, 1)),
        ("5 march 2025 12:30", (2025, 3, 5, 12, 30)),
        ("Sept. 5, 2025 10:00", (2025, 9, 5, 10)),
        ("12/31/2024 12:05 am", (2024, 12, 31, 0, 5)),
        ("12/31/2024 3:05 PM", (2024, 12, 31, 15, 5)),
        ("31/12/2024 12:00:01 PM", (2024, 12, 31, 12, 0, 1)),
        ("31.12.2024 10:00", (2024, 12, 31, 10)),
    ],
)
def test_date_layouts(spark, text, want):
    df = coercion.coerce_types(spark.createDataFrame([(text,), (None,)], "d string"))
    assert df.dtypes == [("d", "timestamp_ntz")]
    assert {r["d"] for r in df.collect()} == {None, datetime.datetime(*want)}


@pytest.mark.parametrize("text", ["31-Foo-2025", "12/31/2024 13:05 PM", "2025-01-02T10:00:00X", "a-b-c", "Mar-Apr-2025"])
def test_what_is_no_date_stays_text(spark, text):
    assert coercion.coerce_types(spark.createDataFrame([(text,)], "d string")).dtypes == [("d", "string")]
