"""Duplicate rows: their number and their groups, both by the values of the rows.

Digests of the rows decide which rows are looked at: those whose digest occurs once are no copies, and
only the others move as a whole. Equal digests prove nothing; the values of the rows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.coercion import quoted
from plumbline.session import scratch_path


def _comparable(field: T.StructField) -> Column:
    """Zero and minus zero are the same value."""
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0).cast(field.dataType)).otherwise(c)
    return c.alias(field.name)


def _candidates(df: DataFrame) -> DataFrame:
    """The rows whose digest occurs more than once, with columns named by their places.

    A row without a copy costs 24 bytes of shuffle. The digests that occur twice are written, so that
    Spark knows their size when it chooses the join.
    """
    names = [str(i) for i in range(len(df.columns))]
    rows = df.select(*(_comparable(f).alias(name) for name, f in zip(names, df.schema)))
    values = [F.col(quoted(name)) for name in names]
    # Nulls leave no trace in the hash, so their places go into it.
    gaps = F.concat(F.lit(""), *(F.when(v.isNull(), "1").otherwise("0") for v in values))
    digests = rows.select(
        F.xxhash64(gaps, *values).alias("__a"), F.xxhash64(*values, gaps, F.lit(1)).alias("__b"), *values
    )
    path = scratch_path(df.sparkSession, "digests")
    digests.groupBy("__a", "__b").agg(F.count("*").alias("n")).where("n > 1").select("__a", "__b").write.parquet(path)
    twice = df.sparkSession.read.schema("__a long, __b long").parquet(path)
    return digests.join(twice, ["__a", "__b"], "left_semi").select(*values)


def duplicate_groups(df: DataFrame, count: str = "copies") -> DataFrame:
    """Every row that occurs more than once, with the number of its copies.

    Copies within a task are combined before they move, so a hot row hardly moves at all.
    """
    found = _candidates(df)
    values = [F.col(quoted(name)) for name in found.columns]
    counted = found.groupBy(*values).agg(F.count("*").alias("__n")).where("__n > 1")
    return counted.select(*(v.alias(name) for v, name in zip(values, df.columns)), F.col("__n").alias(count))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier identical row (null equals null).

    Rows are grouped by their values as in ``duplicate_groups``; no text form of them decides.
    """
    found = _candidates(df)
    return (
        found.groupBy(*(F.col(quoted(name)) for name in found.columns))
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    )
