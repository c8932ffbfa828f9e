"""Keys and references against all combinations on small tables."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import keys


def test_keys_against_all_combinations(spark):
    rng = random.Random(3)
    names = ["a.b", "b", "c", "d"]
    for seed in range(3):
        rows = list({tuple(rng.randrange(k) for k in (3, 6, 9, 40)) for _ in range(25 + seed)})
        df = spark.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names)).repartition(3)
        want = []
        for size in (1, 2, 3):
            for combo in combinations(range(4), size):
                if len({tuple(r[i] for i in combo) for r in rows}) == len(rows) and not any(set(w) <= set(combo) for w in want):
                    want.append(combo)
        assert keys.unique_keys(df, 3) == [tuple(names[i] for i in w) for w in want]


def test_keys_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "x", 0.5), (2, None, 1.5)], "n long, s string, f double")
    assert keys.unique_keys(df) == [("n",)]
    assert keys.unique_keys(df.limit(0)) == []
    assert keys.unique_keys(df.unionAll(df)) == []
    assert keys.detect_keys({"t": df, "u": df.limit(0)}).collect() == [("t", "n")]


def test_a_key_with_one_late_copy_is_none(spark):
    df = spark.range(60_000).select(F.when(F.col("id") == 59_999, 17).otherwise(F.col("id")).alias("k"), "id")
    assert keys.unique_keys(df) == [("id",)]


def test_references(spark):
    parent = spark.range(30_000).select("id", F.concat(F.lit("n"), "id").alias("name"))
    child = spark.range(50_000).select(
        (F.col("id") % 20_000).alias("whole_ref"),
        F.when(F.col("id") == 7, 30_000).otherwise(F.col("id") % 100).alias("almost"),
        F.concat(F.lit("n"), F.col("id") % 10).alias("named"),
        F.col("id").cast("string").alias("digits"),
        F.lit(None).cast("long").alias("nothing"),
    )
    got = {tuple(r) for r in keys.detect_references({"p": parent, "c": child}).collect()}
    assert got == {("c.whole_ref", "p.id", 20_000, 30_000), ("c.named", "p.name", 10, 30_000)}
    assert keys.detect_references({"c": child.select("almost")}).collect() == []
