"""Coercion, profile and analyses on small tables with known answers."""

import datetime
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.cleaning import header_names
from plumbline.operators import analysis, coercion, duplicates, extensions, profile, quantiles, render


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def texts(spark, values):
    return coercion.normalise_missing(table(spark, "v string", *[(v,) for v in values]))


def kind(spark, *values):
    return coercion.vote(texts(spark, values))[0].kind


@given(st.integers(1, 60), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_quorum_truncates(present, numbers):
    v = coercion.Verdict("v", present, min(numbers, present), 0, 0, 0, "iso", 0)
    assert (v.kind == "double") == (v.numbers >= max(1, int(0.9 * present)))


def test_votes(spark):
    assert kind(spark, "1", "2", None) == "bigint"
    assert kind(spark, "1", "2.5") == "double"
    assert kind(spark, "1", "x") == "bigint"  # one of two is enough
    assert kind(spark, "1", "x", "y") == "string"
    assert kind(spark, "a", "b") == "string"
    assert kind(spark, None, "NA", "") == "string"
    assert kind(spark, "True", "false", None) == "boolean"
    assert kind(spark, "20250101", "20250102") == "bigint"
    assert kind(spark, "2025-01-01", "2025-02-30") == "timestamp_ntz"
    assert kind(spark, "ORD-1", "ORD-2", "ORD-3") == "string"
    assert kind(spark, "10:30", "11:45", "12:00") == "string"
    assert kind(spark, "5d", "6f", "0x10") == "string"
    assert kind(spark, "1,200", "1_000", "$3") == "string"
    assert kind(spark, "inf", "-Infinity", " 12 ", "5.", ".5", "1e5") == "double"


def test_values_after_coercion(spark):
    df = coercion.coerce_types(texts(spark, ["1", "2", "$3", "1e400", "N/A", "+4"] + ["5"] * 20))
    got = [r["v"] for r in df.collect()]
    assert got[:6] == [1, 2, None, None, None, 4]
    day = coercion.coerce_types(texts(spark, ["13/01/2025", "02/03/2025 "[:10], "31/12/2024"]))
    assert [r["v"] for r in day.collect()] == [
        datetime.datetime(2025, 1, 13), datetime.datetime(2025, 3, 2), datetime.datetime(2024, 12, 31)
    ]
    month = coercion.coerce_types(texts(spark, ["01/02/2025"]))
    assert month.first()["v"] == datetime.datetime(2025, 1, 2)


def test_headers():
    assert header_names([" a", "a", "", "a.1", None]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "Unnamed: 4"]


def scores(df, **options):
    return profile.table_profile(df, **options).first()


def test_clean_messy_and_constant(spark):
    clean = table(spark, "a bigint, b string", *[(i, str(i)) for i in range(4)])
    assert scores(clean)["quality_score"] == 92.5
    assert scores(clean, text_is_typed=True)["quality_score"] == 100.0
    assert scores(clean)["flags"] == ["no major data-quality issues detected"]
    messy = table(spark, "a double, b string", (1.0, None), *[(None, None)] * 3)
    p = scores(messy)
    assert p["completeness"] == 0.125 and p["quality_score"] < 75 and p["duplicate_rows"] == 2
    assert p["flags"][0] == "7 missing cells; worst column 'b' (100.0% missing)"
    constant = table(spark, "const int, real int", (1, 1), (1, 2), (1, 3))
    assert scores(constant)["flags"] == ["constant/near-empty column(s): const"]


def test_empty_and_single_row(spark):
    p = scores(table(spark, "a int, b string"))
    assert (p["rows"], p["cols"], p["completeness"], p["uniqueness"]) == (0, 2, 1.0, 1.0)
    one = scores(table(spark, "a int, b string", (1, None)))
    assert one["consistency"] == 0.5  # the empty column is junk, the constant one is not
    assert not any("constant" in f for f in one["flags"])


def test_grades(spark):
    df = table(spark, "s double", (90.0,), (89.9,), (75.0,), (74.9,), (60.0,), (59.9,))
    got = [r[0][0] for r in df.select(profile.grade(F.col("s"))).collect()]
    assert got == list("ABBCCD")


def test_profile_of_many_and_approximate(spark):
    a = table(spark, "x int", *[(i % 7,) for i in range(500)])
    b = table(spark, "y string, z double", ("p", 0.0), ("q", -0.0))
    exact = profile.column_profile({"a": a, "b": b})
    got = {(r["table_name"], r["name"]): r["unique"] for r in exact.collect()}
    assert got == {("a", "x"): 7, ("b", "y"): 2, ("b", "z"): 1}
    near = profile.column_profile({"a": a, "b": b}, exact=False)
    assert {(r["table_name"], r["name"]): r["unique"] for r in near.collect()} == got
    assert {r["table_name"]: r["rows"] for r in profile.table_profile({"a": a, "b": b}).collect()} == {
        "a": 500, "b": 2,
    }


def test_long_texts_are_told_apart(spark):
    long = "x" * 500
    df = table(spark, "t string, b binary", (long + "a", b"1"), (long + "b", b"2"), (long + "b", b"2"), ("s", None), (None, b"1"))
    got = {r["name"]: (r["unique"], r["missing"]) for r in profile.column_profile(df).collect()}
    assert got == {"t": (3, 1), "b": (2, 1)}


def test_grouped_profile(spark):
    df = table(spark, "f string, a int, b string", ("p", 1, "x"), ("p", 1, "x"), ("q", None, "y"), ("q", 2, "x"))
    got = {r["table_name"]: r for r in profile.grouped_profile(df, "f").collect()}
    assert (got["p"]["rows"], got["p"]["cols"], got["p"]["duplicate_rows"], got["p"]["total_missing"]) == (2, 2, 1, 0)
    assert (got["q"]["duplicate_rows"], got["q"]["total_missing"]) == (0, 1)
    assert got["p"]["flags"] == ["1 duplicate row(s)", "constant/near-empty column(s): a, b"]


def test_samples_of_sparse_columns(spark):
    rows = [(i, i % 2, "v" if i in (70, 80, 99) else None, None) for i in range(100)]
    df = table(spark, "k int, a int, s string, n string", *rows).repartition(4)
    got = {r["name"]: r["sample"] for r in profile.column_samples(df, ["k"]).collect()}
    assert got == {"k": ["0", "1", "2"], "a": ["0", "1", "0"], "s": ["v", "v", "v"]}
    assert profile.column_samples(df.select("k").coalesce(1)).first()["sample"]


def test_duplicates_with_nulls_and_hot_copies(spark):
    rows = [(None, "a"), ("a", None), (None, "a")] + [("hot", "hot")] * 400 + [(str(i), "u") for i in range(50)]
    df = table(spark, "a string, b string", *rows)
    assert duplicates.duplicate_rows(df).first()[0] == 400
    assert {(r["a"], r["b"]): r["copies"] for r in duplicates.duplicate_groups(df).collect()} == {
        (None, "a"): 2, ("hot", "hot"): 400,
    }


def test_rows_a_microsecond_apart_are_no_duplicates(spark):
    times = spark.sql(
        "SELECT timestamp_micros(m) AS t, CAST(timestamp_micros(m) AS timestamp_ntz) AS n, "
        "array(named_struct('t', timestamp_micros(m))) AS a FROM VALUES (123456L), (123457L), (123999L), (123999L) AS v(m)"
    )
    for df in (times, *(times.select(c) for c in times.columns)):
        assert duplicates.duplicate_rows(df).first()[0] == 1
        assert [r["copies"] for r in duplicates.duplicate_groups(df).collect()] == [2]
    assert profile.table_profile(times.select("t", "n")).first()["duplicate_rows"] == 1


def test_duplicates_of_odd_tables(spark):
    df = table(spark, "n string, `a.b` double", ("x", 0.0), ("x", -0.0), (None, None), (None, None))
    assert duplicates.duplicate_rows(df).first()[0] == 2
    assert duplicates.duplicate_rows(df.limit(0)).first()[0] == 0
    assert duplicates.duplicate_rows(df.select()).first()[0] == 3
    assert duplicates.duplicate_rows(df.limit(0).select()).first()[0] == 0


def test_report_is_redacted(spark):
    df = table(spark, "mail string", ("a@b.org",), ("c@d.org",))
    lines = [r["line"] for r in render.quality_report_lines(df, ["mail"]).orderBy("line_no").collect()]
    assert lines[0] == "DATA SCOUT REPORT (robust loader)"
    assert "  mail :: string | missing 0.0% | unique 2 | e.g. [REDACTED-EMAIL], [REDACTED-EMAIL]" in lines
    assert render.quality_report_markdown(df).count() > 10


@pytest.mark.parametrize("few", [0, 5, 10**6])
@pytest.mark.parametrize("sketch", [3, 50, 10_000])
def test_quantiles_are_exact_whatever_the_sketch(spark, monkeypatch, few, sketch):
    monkeypatch.setattr(quantiles, "_FEW", few)
    monkeypatch.setattr(quantiles, "_SKETCH", sketch)
    monkeypatch.setattr(quantiles, "_SLACK", 2.0 / sketch)
    rng = random.Random(sketch + few)
    a = [rng.choice([7.0] * 5 + [rng.gauss(0, 1e3), float(rng.randrange(4))]) for _ in range(901)]
    b = [rng.expovariate(1e-3) for _ in range(900)] + [None]
    df = table(spark, "a double, b double, c double", *[(x, y, None) for x, y in zip(a, b)]).repartition(5)
    ps = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], ps)
    for name, values in (("a", a), ("b", b[:-1])):
        cuts = [statistics.quantiles(values, n=100, method="inclusive")[int(p * 100) - 1] for p in ps[1:5]]
        expected = [min(values), *cuts, max(values)]
        assert got[name] == pytest.approx(expected, rel=1e-12)
    assert got["c"] == [None] * 6


def test_numeric_summary(spark):
    df = table(spark, "a int, s string, b double", (1, "x", None), (3, "y", 2.0), (None, "z", float("nan")))
    rows = {r["name"]: r for r in analysis.numeric_summary(df).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["count"] == 2 and rows["a"]["mean"] == 2.0 and rows["a"]["median"] == 2.0
    assert rows["b"]["count"] == 1 and rows["b"]["std"] is None and rows["b"]["max"] == 2.0
    near = {r["name"]: r for r in analysis.numeric_summary(df, quartiles="approx").collect()}
    assert near["a"]["q3"] == 3.0
    assert analysis.numeric_summary(df.select("s")).count() == 0


def test_breakdown(spark):
    df = table(
        spark, "k string, r double, u double",
        ("b", 1.0, 2.9), ("a", 1.0, None), ("n", None, 1.0), (None, 99.0, 1.0), ("b", 4.0, 0.0),
    )
    assert [tuple(r) for r in analysis.breakdown(df, "k", "r", "u").collect()] == [
        ("b", 5.0, 2), ("a", 1.0, 0), ("n", 0.0, 1),
    ]
    assert [r["k"] for r in analysis.breakdown(df, "k", "r", top=1).collect()] == ["b"]
    odd = df.toDF("my key.1", "r.1", "u")
    assert analysis.breakdown(odd, "my key.1", "r.1").count() == 3
    with pytest.raises(ValueError, match="'k' is not numeric"):
        analysis.breakdown(df, "k", "k")


def test_chart(spark):
    once = table(spark, "m string, s int", ("b", 2), ("a", None), (None, 5))
    assert {tuple(r) for r in analysis.chart_series(once, "m", "s").collect()} == {
        ("b", 2), ("a", None), (None, 5),
    }
    twice = table(spark, "m string, s int", ("b", 2), ("a", None), ("a", None), (None, 5))
    assert [tuple(r) for r in analysis.chart_series(twice, "m", "s", "line").collect()] == [("a", 0), ("b", 2)]
    with pytest.raises(ValueError, match="'x' not found. Available"):
        analysis.chart_series(once, "x", "s")
    with pytest.raises(ValueError, match="Unsupported chart_type 'pie'"):
        analysis.chart_series(once, "m", "s", "pie")
    with pytest.raises(ValueError, match="not numeric"):
        analysis.chart_series(once, "s", "m")


def test_alert(spark):
    df = table(spark, "A int, B int, C int", (1, None, 3), (4, 5, None))
    row = analysis.missing_alert(df).first()
    assert row["total_missing"] == 2 and row["alert"].endswith("detected in B, C")
    assert analysis.missing_alert(df.select("A")).first()["alert"] == "No missing values detected."


def test_overlap_orphans_recheck(spark):
    a, b = table(spark, "k int", (1,), (2,), (2,), (None,)), table(spark, "j bigint", (2,), (3,), (4,))
    rows = {r["left_column"]: (r["left_values"], r["shared_values"]) for r in extensions.key_overlap({"a": a, "b": b}).collect()}
    assert rows == {"a": (2, 1), "b": (3, 1)}
    assert [tuple(r) for r in extensions.orphans(a, "k", b, "j").collect()] == [(1, 1)]
    assert all(r["confirmed"] for r in extensions.recheck(b, ["j"]).collect())
    assert extensions.outliers(table(spark, "v int", *[(i,) for i in range(20)], (999,)), "v").first()["v"] == 999


def test_correlations_with_gaps_constants_and_infinite_values(spark):
    inf = float("inf")
    rows = [(1.0, 1e9 + 1, None, 7.1, 1.0), (2.0, 1e9 + 3, 1.0, 7.1, inf), (4.0, 1e9 + 2, 5.0, 7.1, None), (None, 1e9, 2.0, 7.1, 3.0)]
    df = table(spark, "`a.b` double, b double, c double, d double, e double", *rows).repartition(3)
    got = {(r["a"], r["b"]): r["correlation"] for r in extensions.correlations(df).collect()}
    assert got["a.b", "b"] == pytest.approx(statistics.correlation([1, 2, 4], [1, 3, 2]))
    assert got["b", "c"] == pytest.approx(statistics.correlation([3, 2, 0], [1, 5, 2]))
    assert got["a.b", "c"] == pytest.approx(1.0)
    assert got["a.b", "d"] is None and got["c", "d"] is None
    assert str(got["b", "e"]) == "nan" and len(got) == 10
    empty = extensions.correlations(df.limit(0)).collect()
    assert all(r["correlation"] is None for r in empty)


def test_correlations_of_many_columns(spark):
    wide = spark.range(300).select(*(F.sin(F.col("id") * (i + 1)).alias(f"v{i}") for i in range(200)))
    got = extensions.correlations(wide)
    picked = {(r["a"], r["b"]): r["correlation"] for r in got.where("a = 'v3' AND b IN ('v9', 'v150')").collect()}
    for (a, b), r in picked.items():
        assert r == pytest.approx(wide.select(F.corr(a, b)).first()[0])
    assert len(picked) == 2 and got.count() == 200 * 199 // 2


def test_rows_without_copies_do_not_move_as_a_whole(spark):
    df = spark.range(5_000).select("id", F.repeat(F.lit("x"), 2_000).alias("text"))
    spark.catalog.clearCache()
    found = duplicates.duplicate_groups(df)
    assert found.count() == 0
    assert duplicates.duplicate_groups(df.unionAll(df.where("id % 1000 = 1"))).select("id", "copies").count() == 5


def test_samples_sort_few_cells(spark):
    """Ties, copies, gaps and sparse columns; and no task sorts the cells of its rows."""
    rows = [(i // 4 if i % 50 else None, f"v{i % 7}", "x" if i % 3 else None, i if i in (30, 990) else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, tied string, same string, sparse int").repartition(5)
    for n in (1, 3, 4):
        found = {r["name"]: r["sample"] for r in profile.column_samples(df, ["k"], n).collect()}
        for i, name in enumerate(df.columns):
            cells = sorted((r[0] is not None, r[0] or 0, str(r[i])) for r in rows if r[i] is not None)
            assert found[name] == [c[2] for c in cells[:n]], (name, n)
    plan = profile.column_samples(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    before_counts = plan[plan.rindex("HashAggregate(keys=[position"):]
    assert "Sort [" not in before_counts and "WindowGroupLimit" not in before_counts


def test_samples_in_the_order_of_the_scan(spark):
    df = spark.range(0, 5000, 1, 3).selectExpr("id", "if(id % 2000 = 1999, id, null) as rare", "cast(null as string) as none")
    found = {r["name"]: r["sample"] for r in profile.column_samples(df).collect()}
    assert found == {"id": ["0", "1", "2"], "rare": ["1999", "3999"]}
    plan = profile.column_samples(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_report_sorts_no_cells_of_its_rows(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 3 as string) as v")
    found = render.quality_report_lines(df, ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan  # with the bounds of the samples
    assert any("e.g. 0, 1, 2" in r["line"] for r in found.collect())


def test_cells_of_the_report_to_be_sorted_stay_few_as_rows_grow(spark):
    places = ["0", "1", "2"]
    for rows in (1_000, 100_000):
        df = spark.range(0, rows, 1, 4).selectExpr("id", "cast(id % 3 as string) as v", "'erp' as origin")
        cells = [F.col(name).cast("string").alias(p) for p, name in zip(places, df.columns)]
        in_order = profile._cells_in_order(df.select(F.struct("id").alias("k"), *cells), places, 3)
        in_tasks = profile._cells_of_tasks(df.select(F.col("id").alias("k"), *cells), places, 3)
        assert 9 <= in_order.count() <= 100, rows
        assert in_tasks.count() == 3 * 3 * 4, rows
        lines = [r["line"] for r in render.quality_report_lines(df, ["id"]).collect()]
        assert [x.partition("e.g. ")[2] for x in lines if "e.g. " in x] == ["0, 1, 2", "0, 1, 2", "erp, erp, erp"]
