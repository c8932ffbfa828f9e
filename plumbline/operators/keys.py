"""Keys and references found in the data, without being told the columns.

Both searches rule out by a sample of values first: the values whose hash is a multiple of a number, with
all their rows. Two sampled rows of one value prove that a column is no key; a sampled value that another
column lacks proves that it does not refer to it. What the sample cannot rule out is checked on all rows,
so nothing is found or lost by chance. The driver sees names and counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.coercion import quoted
from plumbline.operators.extensions import key_overlap

#: Distinct values of a column in the sample, about.
SAMPLED_VALUES = 10_000

_KINDS = (
    (T.IntegralType, "whole"), (T.StringType, "text"), (T.DateType, "date"), (T.TimestampType, "time"),
    (T.TimestampNTZType, "time"),
)


def _kinds(df: DataFrame) -> dict[str, str]:
    """The columns that can be keys, with what they may be compared to. Fractions, lists and such are none."""
    found = {}
    for f in df.schema:
        for kind, name in _KINDS:
            if isinstance(f.dataType, kind):
                found[f.name] = name
    return found


def _in_sample(digest: Column, share: int) -> Column:
    return F.pmod(digest, F.lit(share)) == 0


def _ruled_out(df: DataFrame, combos: list[tuple[str, ...]], share: int) -> set[tuple[str, ...]]:
    """The combinations of which two sampled rows have the same values. One pass for all of them."""
    digests = F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.xxhash64(*(F.col(quoted(c)) for c in combo)).alias("h"))
            for i, combo in enumerate(combos)
        )
    )
    sampled = df.select(F.inline(F.filter(digests, lambda d: _in_sample(d["h"], share))))
    twice = sampled.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1").select("i").distinct()
    return {combos[r["i"]] for r in twice.collect()}


def unique_keys(df: DataFrame, most: int = 2) -> list[tuple[str, ...]]:
    """The smallest sets of up to ``most`` columns whose values tell all rows apart.

    Columns with nulls are in no key, and a table without rows has none. Level by level: a set that
    holds a key is not looked at again.
    """
    columns = list(_kinds(df))
    counts = df.agg(F.count(F.lit(1)), *(F.count(quoted(c)) for c in columns)).first()
    rows = counts[0]
    columns = [c for c, n in zip(columns, counts[1:]) if n == rows]
    keys: list[tuple[str, ...]] = []
    if rows == 0:
        return keys
    share = max(1, rows // SAMPLED_VALUES)
    for size in range(1, most + 1):
        combos = [c for c in combinations(columns, size) if not any(set(k) <= set(c) for k in keys)]
        if not combos:
            break
        out = _ruled_out(df, combos, share)
        for combo in combos:
            if combo not in out:
                values = [F.col(quoted(c)) for c in combo]
                copies = df.groupBy(*values).agg(F.count("*").alias("__n")).where(F.col("__n") > 1)
                if copies.isEmpty():
                    keys.append(combo)
    return keys


def detect_keys(tables: dict[str, DataFrame], most: int = 2) -> DataFrame:
    """(table_name, key): the keys of every table, the columns of one joined by commas."""
    spark = next(iter(tables.values())).sparkSession
    found = [(name, ",".join(key)) for name, df in tables.items() for key in unique_keys(df, most)]
    return spark.createDataFrame(found, "table_name string, key string")


def _may_refer(columns: dict[str, DataFrame], parents: list[str]) -> set[tuple[str, str]]:
    """Pairs of a column and a parent that the sample does not rule out.

    Every sampled value becomes the set of the columns that hold it; pairs are formed among sets.
    """
    rows = max(df.count() for df in columns.values())
    share = max(1, rows // SAMPLED_VALUES)
    names = list(columns)
    held = reduce(
        DataFrame.unionByName,
        (
            df.select(F.xxhash64(F.col(quoted(df.columns[0])).cast("string")).alias("h"), F.lit(i).alias("i"))
            .where(F.col(quoted(df.columns[0])).isNotNull() & _in_sample(F.col("h"), share))
            for i, df in enumerate(columns.values())
        ),
    )
    sets = held.groupBy("h").agg(F.array_sort(F.collect_set("i")).alias("held")).select("held").distinct()
    numbers = [names.index(p) for p in parents]
    lacked = sets.select(
        F.explode("held").alias("i"), F.array_except(F.array(*map(F.lit, numbers)), "held").alias("lacks")
    )
    out = {(names[r["i"]], names[r["j"]]) for r in lacked.select("i", F.explode("lacks").alias("j")).distinct().collect()}
    return {(c, p) for c in names for p in parents if c != p and (c, p) not in out}


def detect_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, child_values, parent_values): columns all of whose values are in a one-column key.

    Columns are named table.column and compared with those of their own kind; nulls refer to nothing,
    and a column without values is no child. The last two columns count distinct values.
    """
    spark = next(iter(tables.values())).sparkSession
    kinds = {f"{t}.{c}": kind for t, df in tables.items() for c, kind in _kinds(df).items()}
    columns = {f"{t}.{c}": df.select(quoted(c)) for t, df in tables.items() for c in _kinds(df)}
    keys = [f"{t}.{k[0]}" for t, df in tables.items() for k in unique_keys(df, 1)]
    parts = []
    for kind in dict.fromkeys(kinds.values()):
        alike = {c: df for c, df in columns.items() if kinds[c] == kind}
        parents = [k for k in keys if k in alike]
        pairs = sorted(_may_refer(alike, parents)) if parents and len(alike) > 1 else []
        if not pairs:
            continue
        open_columns = {c: alike[c] for c in dict.fromkeys(x for pair in pairs for x in pair)}
        overlap = key_overlap(open_columns)
        own = overlap.groupBy(F.col("left_column").alias("parent")).agg(F.max("left_values").alias("parent_values"))
        asked = spark.createDataFrame(pairs, "child string, parent string")
        parts.append(
            overlap.where("left_values > 0 AND shared_values = left_values")
            .select(F.col("left_column").alias("child"), F.col("right_column").alias("parent"), F.col("left_values").alias("child_values"))
            .join(asked, ["child", "parent"], "left_semi")
            .join(own, "parent")
            .select("child", "parent", "child_values", "parent_values")
        )
    empty = spark.createDataFrame([], "child string, parent string, child_values long, parent_values long")
    return reduce(DataFrame.unionByName, parts) if parts else empty
