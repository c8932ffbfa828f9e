"""Files written byte by byte, then sniffed and loaded."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.plans.files import workbook_bytes
from plumbline.sources import delimited, sniff, workbook


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def look(spark, path):
    return sniff.sniff(spark, path).first()


def rows(loaded):
    return [tuple(r) for r in loaded.df.collect()]


def test_encodings(spark, put):
    assert look(spark, put("a.csv", "n\nJosé\n"))["encoding"] == "utf-8"
    assert look(spark, put("b.csv", "n\nJosé\n".encode("latin-1")))["encoding"] == "iso-8859-1"
    for end in ("\n", "", "\r\n"):
        marked = put(f"c{len(end)}.csv", b"\xef\xbb\xbf" + f"n,m\r\n1,2\r\n3,é{end}".encode())
        assert look(spark, marked)["encoding"] == "utf-8-sig", repr(end)
        assert look(spark, marked)["header"] == "n,m"
        assert delimited.load_table(spark, marked).df.columns == ["n", "m"]
    wide = put("d.csv", "n,m\n1,é\n".encode("utf-16"))
    assert look(spark, wide)["encoding"] == "utf-16"
    assert rows(delimited.load_table(spark, wide)) == [(1, "é")]
    assert rows(delimited.load_table(spark, put("e.csv", "n\nMüller\nJosé\n".encode("latin-1")))) == [
        ("Müller",), ("José",),
    ]


def test_code_pages_given_by_hand(spark, tmp_path, put):
    os.mkdir(tmp_path / "cp")
    text = "naïve,price €\n“a, b”,1\n\nŽ,2\nlong,3,4\nshort\n"
    for i in range(2):
        put(f"cp/{i}.csv", text.encode("cp1252"))
    t = delimited.load_table(spark, str(tmp_path / "cp"), encoding="cp1252")
    assert t.df.columns == ["naïve", "price €"]
    assert sorted(rows(t), key=str) == [("short", None)] * 2 + [("Ž", 2)] * 2
    kana = put("k.csv", "名前;値\nソニー;1\n表;2\n".encode("shift_jis"))
    t = delimited.load_table(spark, kana, encoding="shift_jis")
    assert t.df.columns == ["名前", "値"] and rows(t) == [("ソニー", 1), ("表", 2)]


def test_delimiters(spark, put):
    for d, name in ((",", "a.csv"), (";", "b.csv"), ("|", "c.txt"), ("\t", "d.tsv")):
        t = delimited.load_table(spark, put(name, f"a{d}b{d}c\n1{d}2{d}3\n4{d}5{d}6\n"))
        assert t.source["delimiter"] == d and rows(t) == [(1, 2, 3), (4, 5, 6)]
    quoted = put("e.csv", 'a;b\n"x,y,z";1\n"u,v,w";2\n')
    assert look(spark, quoted)["delimiter"] == ";"
    assert look(spark, put("f.csv", "only\nvalues\n"))["delimiter"] == ","


def test_ragged_blank_and_separator_lines(spark, put):
    text = 'a,b,c\n1,2,3\n4,5\n\n6,7,8,9\n10,11,12,\n13,14,15,,\n,,\n"x,""y""",16,17\n   18,19,20 \n'
    df = delimited.read_delimited(spark, put("r.csv", text), ["a", "b", "c"])
    assert [tuple(r) for r in df.collect()] == [
        ("1", "2", "3"), ("4", "5", None), (None, None, None), ('x,"y"', "16", "17"), ("18", "19", "20 "),
    ]
    assert df.count() == 5
    assert [r["b"] for r in df.select("b").collect()] == ["2", "5", None, "16", "19"]
    assert df.where("c = '17'").count() == 1


def test_quoted_line_feeds(spark, put):
    path = put("q.csv", 'id,note\n1,"two\nlines"\n2,"one, ""q"""\n3\n4,5,6\n')
    t = delimited.load_table(spark, path, multiline=True)
    assert rows(t) == [(1, "two\nlines"), (2, 'one, "q"'), (3, None)]


def test_missing_words_votes_and_losses(spark, put):
    body = "".join(f"{i},{i}.5,2025-01-{i:02d}\n" for i in range(1, 20))
    t = delimited.load_table(spark, put("v.csv", f" k , amount ,day\n{body}N/A,$9,n.d.\n"))
    assert t.df.dtypes == [("k", "bigint"), ("amount", "double"), ("day", "timestamp_ntz")]
    assert [v.lost for v in t.verdicts] == [0, 1, 1]
    assert profile.table_profile(t.df).first()["total_missing"] == 3
    assert t.df.orderBy("k").collect()[1]["day"] == datetime.datetime(2025, 1, 1)


def test_first_rows_and_folder(spark, tmp_path, put):
    os.mkdir(tmp_path / "many")
    for i in range(3):
        put(f"many/{i}.csv", f"a,b\n{i},x\n{i},y\n")
    t = delimited.load_table(spark, str(tmp_path / "many"))
    assert t.df.count() == 6 and t.source["files"] == 3 and t.source["lines"] == 9
    some = delimited.load_table(spark, str(tmp_path / "many"), first_rows=2)
    assert some.df.count() == 2 and some.source["sampled"]
    put("many/odd.csv", "other;header\n1;2\n")
    with pytest.raises(ValueError, match="do not share one header"):
        delimited.load_table(spark, str(tmp_path / "many"))


def test_status(spark, tmp_path, put):
    put("ok.csv", "a,b\n1,2\n")
    put("one.csv", "a\n1\n")
    put("none.csv", "\n \n")
    got = sniff.source_status(spark, str(tmp_path)).collect()
    assert {os.path.basename(r["path"]): r["status"] for r in got} == {
        "ok.csv": "ok", "one.csv": "fallback", "none.csv": "empty",
    }
    with pytest.raises(ValueError, match="No readable file"):
        delimited.load_table(spark, str(tmp_path / "none.csv"))


def test_workbook(spark, put, tmp_path):
    book = workbook_bytes({"First": [["a"], [1], [2]], "Second": [["b", " c "], [1.5, "x"], [2, "y & z"], [3, "w"]]})
    put("book.xlsx", book)
    cells = workbook.read_workbooks(spark, str(tmp_path))
    sheets = workbook.sheets_available(cells).orderBy("sheet_no").collect()
    assert [(r["sheet"], r["rows"]) for r in sheets] == [("First", 2), ("Second", 3)]
    first = workbook.sheet_table(cells)
    assert sorted(r["a"] for r in first.collect()) == ["1", "2"]
    second = workbook.sheet_table(cells, "Second").orderBy("row").drop("path", "row")
    assert second.columns == ["b", "c"]
    assert [tuple(r) for r in second.collect()] == [("1.5", "x"), ("2", "y & z"), ("3", "w")]
    with pytest.raises(ValueError, match="Sheet not found"):
        workbook.sheet_table(cells, "Third")


def test_field_count_of_long_quoted_record(spark):
    record = '"' + 'a""b,' * 20_000 + '",x,"y"'
    df = spark.createDataFrame([(record,)], "r string")
    assert df.select(delimited.fields_in(F.col("r"), ",")).first()[0] == 3
