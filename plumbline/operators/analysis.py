"""Analyses of a typed table: numeric summary, breakdowns, chart series, the full report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.operators.coercion import number_columns, quoted, without_nan
from plumbline.operators.profile import column_missing
from plumbline.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def _number(name: str) -> Column:
    c = F.col(quoted(name)).cast("double")
    return F.when(~F.isnan(c), c)


def numeric_summary(
    df: DataFrame, columns: list[str] | None = None, quartiles: str | None = "exact"
) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of each numeric column, one pass.

    ``quartiles`` is ``"exact"`` (a few counting passes), ``"approx"`` (same pass) or None.
    """
    columns = number_columns(df) if columns is None else columns
    schema = "position int, name string"
    if not columns:
        return df.sparkSession.createDataFrame(
            [], schema + ", count bigint, mean double, std double, min double, max double"
        )
    stats = []
    for i, c in enumerate(columns):
        v = _number(c)
        fields = [
            F.lit(i).alias("position"),
            F.lit(c).alias("name"),
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ]
        if quartiles == "approx":
            fields.append(F.percentile_approx(v, QUARTILES, 10_000).alias("quartiles"))
        stats.append(F.struct(*fields))
    long = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    if quartiles is None:
        return long
    if quartiles == "approx":
        q = [F.col("quartiles")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))]
        return long.select(*long.columns[:-1], *q)
    exact = exact_quantiles(df, columns, QUARTILES)
    rows = [(i, *exact[c]) for i, c in enumerate(columns)]
    return long.join(
        df.sparkSession.createDataFrame(
            rows, "position int, q1 double, median double, q3 double"
        ),
        "position",
    )


def missing_alert(df: DataFrame) -> DataFrame:
    """One row: total missing cells, and the columns that have any, in table order."""
    some = F.filter(
        F.array_sort(F.collect_list(F.struct("position", "name", "missing"))),
        lambda c: c["missing"] > 0,
    )
    total = F.sum("missing")
    return column_missing(df).agg(
        total.alias("total_missing"),
        F.when(
            total > 0,
            F.concat(F.lit(fixed.MISSING_ALERT), F.array_join(some["name"], ", ")),
        )
        .otherwise(fixed.NO_ALERT)
        .alias("alert"),
    )


def breakdown(
    df: DataFrame,
    key: str,
    measure: str,
    units: str | None = None,
    top: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Sum of ``measure`` per key, largest first; ``units`` is summed alongside and truncated.

    Rows without a key are left out, NaN counts as missing, and a key with only missing values sums
    to zero. Units beyond a bigint are null. Equal sums
    are ordered by key. Partial sums are combined before the shuffle, so hot keys do no harm.
    """
    for name in (measure, units):
        if name and not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"Column '{name}' is not numeric.")
    amount = F.sum(without_nan(df, measure))
    columns = [F.coalesce(amount, F.lit(0)).cast("double").alias("total")]
    if units:
        pieces = F.coalesce(F.sum(without_nan(df, units)), F.lit(0))
        columns.append(pieces.try_cast("bigint").alias("units"))
    out = df.where(F.col(quoted(key)).isNotNull()).groupBy(quoted(key)).agg(*columns)
    if not ordered:
        return out
    out = out.orderBy(F.desc("total"), quoted(key))
    return out.limit(top) if top else out


CHART_KINDS = ("bar", "line", "scatter")


def chart_series(df: DataFrame, x: str, y: str, kind: str = "bar") -> DataFrame:
    """The (x, y) points of a chart.

    If any x repeats, y is summed per x, missing x are dropped, and the points are ordered by x.
    Otherwise the rows are the points. Both cases share one grouped sum: groups of one row are the
    rows themselves.
    """
    for name in (x, y):
        if name not in df.columns:
            raise ValueError(fixed.NO_COLUMN.format(name, df.columns))
    if kind not in CHART_KINDS:
        raise ValueError(fixed.WRONG_CHART.format(kind, ", ".join(CHART_KINDS)))
    if not isinstance(df.schema[y].dataType, T.NumericType):
        raise ValueError(f"Column '{y}' is not numeric.")
    grouped = df.groupBy(F.col(quoted(x)).alias("x")).agg(
        F.sum(without_nan(df, y)).alias("s"), F.count("*").alias("n")
    )
    repeats = F.col("most") > 1
    # The sum is kept in the maximum, so that both readings of ``grouped`` share one shuffle.
    most = grouped.agg(F.max(F.struct("n", "s"))["n"].alias("most"))
    return (
        grouped.withColumn("most", most.scalar())
        .where(~repeats | F.col("x").isNotNull())
        .select("x", F.when(repeats, F.coalesce("s", F.lit(0))).otherwise(F.col("s")).alias("y"))
        .orderBy("x")
    )


def _item(section: str, name: Column, value: Column) -> list[Column]:
    return [
        F.lit(section).alias("section"),
        name.cast("string").alias("item"),
        value.cast("double").alias("value"),
    ]


def analysis_report(
    df: DataFrame,
    product: str = "Product",
    region: str = "Region",
    revenue: str = "Revenue",
    units: str | None = "Units",
) -> DataFrame:
    """Shape, missing cells, numeric summary and breakdowns as (section, item, value) rows.

    Breakdowns appear only for the columns the table has.
    """
    parts = [
        df.agg(F.count("*").alias("n")).select(*_item("shape", F.lit("rows"), F.col("n"))),
        df.sparkSession.createDataFrame(
            [("shape", "columns", float(len(df.columns)))],
            "section string, item string, value double",
        ),
    ]
    missing = column_missing(df)
    parts.append(missing.select(*_item("missing", F.col("name"), F.col("missing"))))
    numeric = numeric_summary(df, quartiles=None)
    if number_columns(df):
        stats = numeric.unpivot("name", ["mean", "std", "min", "max"], "stat", "value")
        parts.append(
            stats.select(*_item("numeric", F.concat_ws(".", "name", "stat"), F.col("value")))
        )
    for section, key in (("product", product), ("region", region)):
        if key in df.columns and revenue in df.columns:
            extra = units if units in df.columns else None
            totals = breakdown(df, key, revenue, extra, ordered=False)
            shown = {".revenue": "total", **({".units": "units"} if extra else {})}
            items = [
                F.struct(*_item(section, F.concat(key, F.lit(ending)), F.col(c)))
                for ending, c in shown.items()
            ]
            parts.append(totals.select(F.inline(F.array(*items))))
    return reduce(DataFrame.unionByName, parts)


def joined_breakdown(
    facts: DataFrame,
    fact_key: str,
    dimension: DataFrame,
    dimension_key: str,
    key: str,
    measure: str,
    units: str | None = None,
    top: int | None = None,
) -> DataFrame:
    """A breakdown by an attribute that sits in another table.

    Facts are summed per join key before the join, so a key with a third of all facts reaches the
    join as one row.
    """
    sums = [F.sum(without_nan(facts, measure)).alias("__measure")]
    if units:
        sums.append(F.sum(without_nan(facts, units)).alias("__units"))
    totals = (
        facts.where(F.col(fact_key).isNotNull())
        .groupBy(F.col(fact_key).alias("__key"))
        .agg(*sums)
    )
    joined = totals.join(dimension, totals["__key"] == dimension[dimension_key])
    return breakdown(joined, key, "__measure", "__units" if units else None, top)
