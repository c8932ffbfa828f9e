"""Rows of files by number: the first ones, samples, and their independence of how files are split."""

import csv
import hashlib
import io
import os
import random

import pytest

from plumbline.sources import delimited


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def use(n):
        spark.conf.set(key, str(n))

    yield use
    spark.conf.set(key, before)


def write(folder, files, newline="\n", encoding="utf-8"):
    """Files of (k, v) rows; the rows of all, in the order of the files' names."""
    os.makedirs(folder, exist_ok=True)
    for name, rows in files.items():
        out = io.StringIO()
        csv.writer(out, lineterminator=newline).writerows([("k", "v"), *rows])
        (folder / name).write_bytes(out.getvalue().encode(encoding))
    return [row for name in sorted(files) for row in files[name]]


def mixed_files(folder, spanning, seed=7):
    random.seed(seed)
    files = {}
    for i in range(20):
        rows = []
        for j in range(random.choice([1, 3, 60])):
            text = "x" * random.randrange(40) + ("\nline, \"two\"\n" if spanning and random.random() < 0.4 else "")
            rows.append((str(1000 * i + j), f"{text}|"))
        files[f"f{random.randrange(10**6):06d}.csv"] = rows
    return write(folder, files)


def taken(loaded):
    rows = loaded.df.orderBy("n").collect()
    return [r["n"] for r in rows], [(str(r["k"]), r["v"]) for r in rows]


@pytest.mark.parametrize("spanning", [False, True])
def test_first_rows_in_file_order(spark, tmp_path, small_splits, spanning):
    rows = mixed_files(tmp_path / "d", spanning)
    for split in (700, 10_000_000):
        small_splits(split)
        for n in (0, 1, 37, len(rows) - 1, len(rows), len(rows) + 9):
            got = delimited.load_table(spark, str(tmp_path / "d"), first_rows=n, row_column="n")
            numbers, found = taken(got)
            assert numbers == list(range(min(n, len(rows))))
            assert found == rows[:n]
            assert got.source["sampled"] == (n < len(rows))


def test_files_behind_the_last_row_are_not_read(spark, tmp_path):
    rows = write(tmp_path / "d", {f"{i:03d}.csv": [(str(i), "v"), (str(i), "w")] for i in range(40)})
    got = delimited.load_table(spark, str(tmp_path / "d"), first_rows=3, row_column="n", path_column="p")
    assert taken(got)[1] == rows[:3]
    assert {os.path.basename(r["p"]) for r in got.df.collect()} == {"000.csv", "001.csv"}


def smallest_digests(rows, n, seed):
    order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return sorted(order[:n])


@pytest.mark.parametrize("spanning", [False, True])
def test_samples_do_not_depend_on_splits(spark, tmp_path, small_splits, spanning):
    rows = mixed_files(tmp_path / "d", spanning)
    for split in (700, 10_000_000):
        small_splits(split)
        for n, seed in ((0, 0), (1, 0), (50, 0), (50, 3), (len(rows), 0), (len(rows) + 5, 0)):
            got = delimited.load_table(spark, str(tmp_path / "d"), sample_rows=n, seed=seed, row_column="n")
            numbers, found = taken(got)
            assert numbers == smallest_digests(rows, n, seed)
            assert found == [rows[i] for i in numbers]
            assert got.source["sampled"] == (n < len(rows))


def test_equal_rows_are_drawn_one_by_one(spark, tmp_path):
    rows = write(tmp_path / "d", {"a.csv": [("1", "same")] * 9000})
    got = delimited.load_table(spark, str(tmp_path / "d"), sample_rows=5000, row_column="n")
    assert taken(got)[0] == smallest_digests(rows, 5000, 0)


def test_numbers_of_all_rows_and_other_encodings(spark, tmp_path):
    rows = write(tmp_path / "d", {"a.csv": [("1", "é"), ("2", "b")], "b.csv": [("3", "–")]}, encoding="cp1252")
    whole = delimited.load_table(spark, str(tmp_path / "d"), encoding="cp1252", row_column="n")
    assert taken(whole) == ([0, 1, 2], rows) and not whole.source["sampled"]
    known = {"encoding": "cp1252", "delimiter": ",", "names": ["k", "v"]}
    assert taken(delimited.load_table(spark, str(tmp_path / "d"), first_rows=2, row_column="n", **known))[1] == rows[:2]
    wide = write(tmp_path / "w", {"a.csv": [("1", "é"), ("2", "b")], "b.csv": [("3", "c")]}, encoding="utf-16")
    assert taken(delimited.load_table(spark, str(tmp_path / "w"), first_rows=3, row_column="n"))[1] == wide


def test_blank_and_long_records_get_no_number(spark, tmp_path):
    os.mkdir(tmp_path / "d")
    (tmp_path / "d" / "a.csv").write_text("k,v\n\n1,a\n  \n2,b,c,d\n3\n")
    (tmp_path / "d" / "b.csv").write_text("k,v\n")
    (tmp_path / "d" / "c.csv").write_text("k,v\n4,d\n")
    got = delimited.load_table(spark, str(tmp_path / "d"), first_rows=3, row_column="n")
    assert taken(got) == ([0, 1, 2], [("1", "a"), ("3", None), ("4", "d")])
    both = {"first_rows": 1, "sample_rows": 1}
    with pytest.raises(ValueError, match="exclude"):
        delimited.load_table(spark, str(tmp_path / "d"), **both)
