"""Folders of mixed files: what is read, what is said of the rest, and the reports."""

import pytest

from plumbline.plans.files import workbook_bytes
from plumbline.sources import folder


@pytest.fixture
def mixed(tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.csv").write_text("k,name,v\n1,x,1.5\n2,y,2.5\n")
    (tmp_path / "sub dir" / "b c.tsv").write_text("k\tname\tv\n3\tz\t3.5\n")
    (tmp_path / "c.txt").write_bytes("name;k;extra\né;4;2025-01-02\n".encode("latin-1"))
    (tmp_path / "d.csv").write_text('k,name,v\n5,"two\nlines",N/A\n')
    (tmp_path / "e.json").write_text("{}")
    (tmp_path / "f.xls").write_text("old")
    (tmp_path / "g.xlsx").write_text("no workbook")
    (tmp_path / "blank.csv").write_text("\n \n")
    (tmp_path / "h.xlsx").write_bytes(workbook_bytes({"First": [["v", " k "], [6.5, 6], ["n/a", 7]], "Second": [["q"], [1]]}))
    (tmp_path / "i.xlsx").write_bytes(workbook_bytes({"One": [["k", "name"], [8, "w"]]}))
    return tmp_path


def test_mixed_folder(spark, mixed):
    loaded = folder.load_folder(spark, str(mixed), path_column="from")
    rows = [(r.k, r["name"], r.v, r["from"].split("/")[-1]) for r in loaded.df.orderBy("k").collect()]
    assert rows == [
        (1, "x", 1.5, "a.csv"), (2, "y", 2.5, "a.csv"), (3, "z", 3.5, "b%20c.tsv"), (4, "é", None, "c.txt"),
        (5, "two\nlines", None, "d.csv"), (6, None, 6.5, "h.xlsx"), (7, None, None, "h.xlsx"), (8, "w", None, "i.xlsx"),
    ]
    status = {r["file"]: (r["status"], r["encoding"], r["delimiter"], r["sheets"]) for r in loaded.status.collect()}
    assert status == {
        "a.csv": ("ok", "utf-8", ",", None), "b c.tsv": ("ok", "utf-8", "\t", None),
        "c.txt": ("ok", "iso-8859-1", ";", None), "d.csv": ("ok", "utf-8", ",", None),
        "blank.csv": ("empty", "utf-8", ",", None), "e.json": ("refused", None, None, None),
        "f.xls": ("unsupported", None, None, None), "g.xlsx": ("unreadable", None, None, []),
        "h.xlsx": ("ok", None, None, ["First", "Second"]), "i.xlsx": ("ok", None, None, ["One"]),
    }
    profile = loaded.profile.first()
    assert (profile["rows"], profile["cols"], profile["total_missing"]) == (8, 4, 13)
    assert loaded.source["files"] == 6


def test_one_file(spark, mixed):
    loaded = folder.load_folder(spark, str(mixed / "h.xlsx"))
    assert sorted(tuple(r) for r in loaded.df.select("k", "v").collect()) == [(6, 6.5), (7, None)]
    facts = loaded.source
    assert (facts["file"], facts["sheet"], facts["sheets_available"]) == ("h.xlsx", "First", ["First", "Second"])
    second = folder.load_folder(spark, str(mixed / "h.xlsx"), sheet="Second")
    assert [tuple(r) for r in second.df.collect()] == [(1,)] and second.source["sheet"] == "Second"
    assert folder.load_folder(spark, str(mixed / "sub dir" / "b c.tsv")).source["file"] == "b c.tsv"


def lines(df):
    return [r["line"] for r in df.orderBy(*df.columns[:-1]).collect()]


def test_reports_by_path(spark, mixed, tmp_path):
    said = lines(folder.quality_report(spark, str(mixed / "a.csv"), order_by=["k"]))
    assert said[2:4] == ["File: a.csv", "Encoding: utf-8 | Delimiter: ',' | Size: 25 bytes"]
    assert "  k :: bigint | missing 0.0% | unique 2 | e.g. 1, 2" in said
    (tmp_path / "sales.csv").write_text("Product,Revenue,Units\nLaptop,1200,2\nMouse,25,5\nKeyboard,75,3\n")
    said = lines(folder.analysis_report(spark, str(tmp_path / "sales.csv")))
    assert {"DATA SCOUT REPORT", "File: sales.csv", "Rows: 3", "  Laptop: $1,200 revenue, 2 units"} <= set(said)


@pytest.mark.parametrize(
    "name, why",
    [
        ("nope.csv", "File not found: "),
        ("e.json", "Invalid file type: .json. Allowed: .csv, .tsv, .txt, .xlsx, .xls"),
        ("g.xlsx", "BadZipFile: File is not a zip file"),
        ("blank.csv", "No readable file at "),
        ("f.xls", "No readable file at "),
    ],
)
def test_what_cannot_be_read(spark, mixed, name, why):
    (said,) = lines(folder.quality_report(spark, str(mixed / name)))
    assert said.startswith(f"SECURITY_ERROR: {why}")
    with pytest.raises(folder.Refused):
        folder.load_folder(spark, str(mixed / name))


def test_endings_differ_by_report(spark, mixed):
    (said,) = lines(folder.analysis_report(spark, str(mixed / "c.txt")))
    assert said == "SECURITY_ERROR: Invalid file type: .txt. Allowed: .csv, .xlsx, .xls"
    assert "Rows: 6" in lines(folder.analysis_report(spark, str(mixed), product="name", revenue="v"))


@pytest.mark.parametrize("listed", [1, 3])
def test_more_files_than_are_told_apart_by_name(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(folder, "LISTED_FILES", listed)
    for i in range(4):
        (tmp_path / f"a {i}.csv").write_text(f"k,v\n{i},1\n")
    for i in range(2):
        (tmp_path / f"b{i}.csv").write_text(f"k;w\n{10 + i};2\n")
    rows = folder.load_folder(spark, str(tmp_path)).df.orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(i, 1, None) for i in range(4)] + [(10 + i, None, 2) for i in range(2)]


def test_many_kinds_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "MOST_KINDS", 2)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"k{i}\n1\n")
    with pytest.raises(folder.Refused, match="more than 2 kinds"):
        folder.load_folder(spark, str(tmp_path))


def test_report_does_not_make_the_profile_twice(spark, tmp_path, monkeypatch):
    """The table is read for the report alone, and from rows written once."""
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n2,y\n")
    (tmp_path / "b.csv").write_text("v,k\nz,3\n")
    made, profiles = [], []
    lines, table = folder.render.quality_report_lines, folder.profile.table_profile
    monkeypatch.setattr(folder.render, "quality_report_lines", lambda df, *a, **k: made.append(df) or lines(df, *a, **k))
    monkeypatch.setattr(folder.profile, "table_profile", lambda *a, **k: profiles.append(a) or table(*a, **k))
    found = [r["line"] for r in folder.quality_report(spark, str(tmp_path), order_by=["k"]).orderBy("line_no").collect()]
    assert any("1, 2, 2" in line for line in found)
    assert not profiles
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "ExistingRDD" in plan
