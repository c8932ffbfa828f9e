"""Stored profiles of a growing folder against profiles of the whole folder."""

import os

import pytest

from plumbline.operators import profile, stored
from plumbline.sources.delimited import load_table


@pytest.fixture
def store(spark, tmp_path):
    return stored.ProfileStore(spark, str(tmp_path / "store"))


def put(folder, name, rows, head="k,v,w"):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("\n".join([head, *rows]) + "\n")


def lines(a, b):
    return [f"{i},{i % 7}.5,{'N/A' if i % 3 == 0 else 'x'}" for i in range(a, b)]


def same(spark, store, path):
    whole = load_table(spark, path).df
    got, want = store.profile(path).first(), profile.table_profile(whole).first()
    exact = ["rows", "cols", "duplicate_rows", "total_missing", "completeness", "uniqueness", "validity", "consistency",
             "quality_score", "quality_grade", "flags"]
    assert [got[c] for c in exact] == [want[c] for c in exact]
    near = {r["name"]: r for r in profile.column_profile(whole).collect()}
    for r in store.columns(path).collect():
        w = near[r["name"]]
        assert (r["dtype"], r["rows"], r["missing"], r["position"]) == (w["dtype"], w["rows"], w["missing"], w["position"])
        assert abs(r["unique"] - w["unique"]) <= 0.05 * w["unique"]


def test_one_more_file_is_one_file_read(spark, store, tmp_path, monkeypatch):
    folder, read = tmp_path / "d", []
    kept = stored.load_table
    monkeypatch.setattr(stored, "load_table", lambda spark, path, **o: read.append(path) or kept(spark, path, **o))
    put(folder, "a.csv", lines(0, 3000))
    put(folder, "b c.csv", lines(2000, 4000))
    assert store.update(str(folder)) == 2 and store.update(str(folder)) == 0
    same(spark, store, str(folder))
    put(folder, "c.csv", [*lines(3900, 4500), "bad,1,y", "7,,", "7,,"])
    assert store.update(str(folder)) == 1
    assert len(read) == 2 and len(read[1]) == 1 and read[1][0].endswith("/c.csv")
    same(spark, store, str(folder))
    put(folder, "a.csv", lines(10, 20))  # changed
    os.remove(folder / "b c.csv")  # gone
    assert store.update(str(folder)) == 1
    same(spark, store, str(folder))


def test_an_unfinished_update_does_not_count(spark, store, tmp_path):
    folder = tmp_path / "d"
    put(folder, "a.csv", lines(0, 50))
    store.update(str(folder))
    left = spark.createDataFrame([("lost", f"file://{folder}/a.csv", 1, 2, 9)], stored._ROWS)
    left.write.mode("append").parquet(f"{store.root}/rows")
    same(spark, store, str(folder))


def test_columns_that_come_later_and_blank_files(spark, store, tmp_path):
    folder = tmp_path / "d"
    put(folder, "a.csv", ["1,a,x", "2,b,"])
    store.update(str(folder))
    put(folder, "b.csv", ["3,1", "4,2"], head="k,z")
    assert store.update(str(folder)) == 1
    put(folder, "c.csv", [], head=" ")
    assert store.update(str(folder)) == 1 and store.update(str(folder)) == 0
    got = {r["name"]: (r["dtype"], r["rows"], r["missing"], r["unique"]) for r in store.columns(str(folder)).collect()}
    assert got == {"k": ("bigint", 4, 0, 4), "v": ("string", 4, 2, 2), "w": ("string", 4, 3, 1), "z": ("bigint", 4, 2, 2)}
    assert store.profile(str(folder)).first()["total_missing"] == 7
