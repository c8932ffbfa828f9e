"""Records that span lines, read in splits of a few bytes, against reading whole files."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import records
from plumbline.sources.delimited import load_table, read_delimited


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def cell(rng):
    bits = ["a", "b c", '"', "\n", "\n\n", ",", "é", "  ", "日本", '""', "x" * 40, "5\""]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))


def content(rng, rows, end):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["k", "a", "b"])
    table = [[str(i), cell(rng), cell(rng)] for i in range(rows)]
    for row in table:
        writer.writerow(row)
        if rng.random() < 0.1:
            out.write(end)
    return out.getvalue(), table


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shown(text):
    """As the reader gives a cell: blanks in front of a bare one are dropped, an empty one is null."""
    return (text if any(c in text for c in ',"\n\r') else text.lstrip(" ")) or None


@pytest.mark.parametrize("seed, end", [(0, "\n"), (1, "\r\n")])
def test_many_splits_against_the_csv_library(spark, small_splits, tmp_path, seed, end):
    rng, tables = random.Random(seed), []
    for i in range(4):
        text, table = content(rng, 40, end)
        tables.append([[k, a, b] for k, a, b in table])
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    raw = spark.read.text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 40
    got = read_delimited(spark, str(tmp_path), ["k", "a", "b"], multiline=True)
    want = [(k, shown(a), shown(b)) for table in tables for k, a, b in table]
    assert read(got) == sorted(want, key=repr)
    for few in (0, 10_000):
        found = records.read_records(spark, str(tmp_path), broadcast_splits=few)
        kept = read(found.select(F.substring_index("record", ",", 1)))
        assert [k for (k,) in kept] == sorted((row[0] for t in tables for row in t), key=lambda k: repr((k,)))


@pytest.mark.parametrize("few", [0, 10_000])
def test_pieces_across_splits(spark, small_splits, tmp_path, few):
    long = "word\n" * 200
    (tmp_path / "a.csv").write_text(f'k,"head\ner{"r" * 100}\n"\n1,"{long}"\n\n2,x\n3,"{long}{long}"\n')
    (tmp_path / "b.csv").write_text('k,h\n4,"never closed\n5,x\n' + "6,y\n" * 50)
    (tmp_path / "c.csv").write_text('\n \nk,h\n7,5" disk\n8,"a""b"\n')
    got = read(records.read_records(spark, str(tmp_path), broadcast_splits=few).select("record"))
    want = [f'1,"{long}"', "2,x", f'3,"{long}{long}"', '4,"never closed\n5,x\n' + "6,y\n" * 49 + "6,y"]
    want += ['7,5" disk', '8,"a""b"']
    assert got == sorted(((w,) for w in want), key=repr)


def test_loader_reads_spanning_files_in_many_tasks(spark, small_splits, tmp_path):
    rng = random.Random(9)
    want = []
    for i in range(5):
        rows = [[str(100 * i + j), "two\nlines, " + "z" * rng.randint(0, 30) if i == 0 else "one"] for j in range(60)]
        want += [(int(k), v) for k, v in rows]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["k", "v"], *rows])
        (tmp_path / f"p {i}.csv").write_text(out.getvalue())
    loaded = load_table(spark, str(tmp_path), path_column="file")
    assert sorted((r.k, r.v) for r in loaded.df.collect()) == sorted(want)
    assert {r.file[-5:] for r in loaded.df.select("file").distinct().collect()} == {f"{i}.csv" for i in range(5)}
    spanning = read_delimited(spark, str(tmp_path / "p 0.csv"), ["k", "v"], multiline=True)
    assert spanning.rdd.getNumPartitions() > 10


def test_latin_text_and_carriage_returns(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_bytes('k;v\n1;"é\nü"\n2;"ö"\n'.encode("latin-1"))
    assert read(load_table(spark, str(tmp_path / "a.csv")).df) == [(1, "é\nü"), (2, "ö")]
    (tmp_path / "b.csv").write_bytes(b'a,b\r1,x\r2,"y\rz"\r3,w\r')
    loaded = load_table(spark, str(tmp_path / "b.csv"))
    assert read(loaded.df) == [(1, "x"), (2, "y\rz"), (3, "w")]
    assert loaded.source["lines"] == 5


def test_states_against_a_fold():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(0, 12)
        opens, stays, entry = rng.random(n) < 0.5, rng.random(n) < 0.5, bool(rng.random() < 0.5)
        want = [entry]
        for o, s in zip(opens, stays):
            want.append(bool(s) if want[-1] else bool(o))
        assert records._states(opens, stays, entry).tolist() == want


@pytest.mark.parametrize(
    "line, opens, stays",
    [
        ("a,b", False, True),
        ('a,"b', True, False),
        ('b",c', False, False),
        ('b",c,"d', True, True),
        ('""', False, True),
        ('"""', True, False),
        ('a,"b""', True, False),
        ('5" disk', False, False),
        ('x, "y', True, False),
        ('"a" "b', False, False),
        ("", False, True),
        ('"' + 'a""' * 20_000, True, False),
        ('a""' * 20_000, False, True),
    ],
)
def test_lines_as_functions(spark, line, opens, stays):
    df = spark.createDataFrame([(line,)], "v string")
    got = df.select(records._left_open(F.col("v"), ","), records._stays_open(F.col("v"), ",")).first()
    assert tuple(got) == (opens, stays)


def test_changed_splits_are_an_error(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n' + '1,"x\ny"\n' * 100)
    df = records.read_records(spark, str(tmp_path))
    lines = records._lines(spark, str(tmp_path), ",", "UTF-8", "\n", None)
    entries = records._entries(records._split_functions(lines))
    wrong = entries.withColumn("size", F.col("size") + 1)
    assert df.count() == 100
    with pytest.raises(Exception, match="split anew"):
        records._with_entries(lines, wrong, True).collect()


def test_records_that_span_lines_are_put_together_once(spark, tmp_path):
    """The vote and the table read rows written once, and sniffing takes the quotes out of a line once."""
    (tmp_path / "a.csv").write_text('id,t\n"1","x, ""y""\nz"\n"2","no line"\n3,5" wide\n')
    loaded = load_table(spark, str(tmp_path))
    assert [tuple(r) for r in loaded.df.orderBy("id").collect()] == [(1, 'x, "y"\nz'), (2, "no line"), (3, '5" wide')]
    plan = loaded.df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "MapInArrow" not in plan
