"""Analyses that reports promise in words: correlation, distribution, outliers, growth, joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.analysis import QUARTILES, numeric_summary
from plumbline.operators.coercion import number_columns, quoted, without_nan
from plumbline.operators.quantiles import exact_quantiles

#: Sums over the rows that have both x and y: rows, x, y, squares, products, infinite values.
_SUMS = ("n", "x", "y", "xx", "yy", "xy", "wild")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns.

    A pair uses the rows where both values are numbers; it has no correlation if they are fewer than
    two or one side does not vary there, and NaN if one side is infinite there. With fewer than two
    columns there are no pairs.

    Every task multiplies blocks of rows into sums for all pairs at once and sends one row per pair.
    Values are taken from the mean of their column, so the sums do not cancel.
    """
    columns = number_columns(df) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    plain = [f"c{i}" for i in range(len(columns))]
    values = df.select(*(without_nan(df, c).cast("double").alias(p) for c, p in zip(columns, plain)))
    finite = (F.when(F.abs(p) < float("inf"), F.col(p)) for p in plain)
    means = values.agg(*(F.avg(c) for c in finite)).first()
    middle = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    left, right = np.triu_indices(len(plain), 1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            wild = np.isinf(x)
            x = np.where(there & ~wild, x - middle, 0.0)
            m, w, xx = there.astype(float), wild.astype(float), x * x
            new = np.stack([m.T @ m, x.T @ m, m.T @ x, xx.T @ m, m.T @ xx, x.T @ x, w.T @ m + m.T @ w])
            sums = new if sums is None else sums + new
        if sums is not None:
            picked = [pa.array(s[left, right]) for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *picked], names=["i", "j", *_SUMS]
            )

    parts = values.mapInArrow(multiply, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    total = parts.groupBy("i", "j").agg(*(F.sum(s).alias(s) for s in _SUMS))

    def spread(square: str, plain_sum: str) -> Column:
        left_over = F.col(square) - F.col(plain_sum) * F.col(plain_sum) / F.col("n")
        # What rounding leaves of a side that does not vary.
        return F.when(left_over > F.col(square) * 1e-12, left_over)

    together = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    ratio = together / F.sqrt(spread("xx", "x")) / F.sqrt(spread("yy", "y"))
    names = F.array(*map(F.lit, columns))
    return total.select(
        F.get(names, F.col("i")).alias("a"),
        F.get(names, F.col("j")).alias("b"),
        F.when(F.col("wild") > 0, float("nan"))
        .when((F.col("n") > 1) & ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
        .alias("correlation"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; the maximum is in the last bin.

    Nulls and NaN are in no bin.
    """
    value = without_nan(df, column).cast("double")
    span = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("span"))
    low, high = F.col("span")["low"], F.col("span")["high"]
    bin_no = F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1))
    )
    return (
        df.where(value.isNotNull())
        .select(value.alias("v"))
        .withColumn("span", span.scalar())
        .groupBy(bin_no.cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def outliers(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences. The fences are two exact numbers, the rest a filter."""
    q1, _, q3 = exact_quantiles(df, [column], QUARTILES)[column]
    if q1 is None:
        return df.limit(0)
    width = reach * (q3 - q1)
    c = without_nan(df, column)
    return df.where((c < q1 - width) | (c > q3 + width))


def growth(df: DataFrame, ts: str, measure: str, by: str) -> DataFrame:
    """Monthly totals with their change against the calendar month before, per ``by``.

    There is no change where that month has no rows or a total of zero. The window runs over months,
    after the sums, so it is as small as the calendar.
    """
    monthly = df.groupBy(by, F.date_trunc("month", ts).cast("date").alias("month")).agg(
        F.sum(without_nan(df, measure)).alias("total")
    )
    in_order = Window.partitionBy(by).orderBy("month")
    adjacent = F.lag("month").over(in_order) == F.add_months("month", -1)
    before = F.when(adjacent, F.lag("total").over(in_order))
    change = F.try_divide(F.col("total"), before) - 1
    return monthly.select(by, "month", "total", change.alias("growth"))


def key_overlap(columns: dict[str, DataFrame]) -> DataFrame:
    """How far the distinct values of one column are found in another, for every pair.

    Each distinct value is reduced to the set of the columns that hold it. Counting equal sets leaves
    a table of few rows, and pairs are formed there, never among values.
    """
    names = list(columns)
    held = reduce(
        DataFrame.unionByName,
        (
            df.select(
                F.col(quoted(df.columns[0])).cast("string").alias("v"),
                F.lit(i).alias("column_no"),
            )
            for i, df in enumerate(columns.values())
        ),
    ).where(F.col("v").isNotNull())
    sets = (
        held.groupBy("v")
        .agg(F.array_sort(F.collect_set("column_no")).alias("held"))
        .groupBy("held")
        .agg(F.count("*").alias("n"))
    )
    shared = (
        sets.select("n", F.explode("held").alias("i"), "held")
        .select("n", "i", F.explode("held").alias("j"))
        .groupBy("i", "j")
        .agg(F.sum("n").alias("shared"))
    )
    spark = next(iter(columns.values())).sparkSession
    numbers = spark.createDataFrame(list(enumerate(names)), "no int, name string")
    left = numbers.select(F.col("no").alias("i"), F.col("name").alias("left_column"))
    right = numbers.select(F.col("no").alias("j"), F.col("name").alias("right_column"))
    own = shared.where("i = j").select("i", F.col("shared").alias("left_values"))
    # One row per pair of columns: as many as the answer has.
    pairs = left.join(right, F.col("i") != F.col("j"))
    return (
        pairs.join(own, "i", "left")
        .join(shared, ["i", "j"], "left")
        .select(
            "left_column",
            "right_column",
            F.coalesce("left_values", F.lit(0)).alias("left_values"),
            F.coalesce("shared", F.lit(0)).alias("shared_values"),
        )
        .withColumn("overlap", F.col("shared_values") / F.greatest("left_values", F.lit(1)))
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent row, with their number of rows.

    Child rows are counted per key first, so the anti join sees every key once.
    """
    counted = (
        child.where(F.col(quoted(key)).isNotNull())
        .groupBy(F.col(quoted(key)).alias("orphan_key"))
        .agg(F.count("*").alias("child_rows"))
    )
    return counted.join(
        parent, counted["orphan_key"] == parent[parent_key], "left_anti"
    )


def recheck(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Numeric statistics computed twice by independent plans, and whether they agree.

    The first plan aggregates whole columns; the second sums counted distinct values.
    """
    stats = ["count", "mean", "min", "max"]
    first = numeric_summary(df, columns, quartiles=None).select(
        "name", "count", F.round("mean", digits).alias("mean"), "min", "max"
    )
    values = (
        df.select(*(F.col(quoted(c)).cast("double").alias(c) for c in columns))
        .unpivot([], columns, "name", "v")
        .where(F.col("v").isNotNull())
        .groupBy("name", "v")
        .agg(F.count("*").alias("n"))
    )
    second = values.groupBy("name").agg(
        F.sum("n").alias("count"),
        F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), digits).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    wrong = first.exceptAll(second).select("name", F.lit(True).alias("differs"))
    return first.join(wrong, "name", "left").select(
        "name", *stats, F.col("differs").isNull().alias("confirmed")
    )
