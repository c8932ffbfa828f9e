"""The data-quality profile of one or many tables.

All cells are unpivoted to (table, column, value) and counted once: the nulls give the missing
cells, the groups give the distinct values. Constant columns and hot values are combined before
the shuffle. Everything after that count is as small as the schemas.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.operators.coercion import quoted
from plumbline.operators.duplicates import duplicate_groups, duplicate_rows

_KEY = ["table_name", "position"]
_META = "table_name string, position int, name string, dtype string"


_LONG = 100
_MARK = "\0"


def _as_text(field: T.StructField) -> Column:
    """The value as a text to be counted.

    A long text is counted by its SHA-256 digest, so that a column of documents shuffles digests
    and not documents. A digest has a mark in front, and so has a short text that begins with the
    mark, with another letter behind: no text is taken for a digest.
    """
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, T.StringType):
        digest = F.concat(F.lit(_MARK + "d"), F.sha2(c, 256))
        marked = F.concat(F.lit(_MARK + "t"), c)
        short = F.when(F.startswith(c, F.lit(_MARK)), marked).otherwise(c)
        return F.when(F.octet_length(c) > _LONG, digest).otherwise(short)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0)).when(~F.isnan(c), c)
    elif isinstance(field.dataType, T.BinaryType):
        return F.sha2(c, 256)
    elif not isinstance(field.dataType, T.AtomicType):
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def _cells(df: DataFrame, table: Column, without: str | None = None) -> DataFrame:
    fields = [f for f in df.schema if f.name != without]
    places = [str(i) for i in range(len(fields))]
    wide = df.select(
        table.alias("table_name"), *(_as_text(f).alias(p) for p, f in zip(places, fields))
    )
    return wide.unpivot(["table_name"], places, "position", "value").withColumn(
        "position", F.col("position").cast("int")
    )


def _metadata(tables: Mapping[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (table, i, name, dtype)
        for table, df in tables.items()
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return spark.createDataFrame(rows, _META)


def column_profile(
    tables: DataFrame | Mapping[str, DataFrame], exact: bool = True
) -> DataFrame:
    """Per column: rows, missing cells, distinct values, and both as a percentage of the rows.

    ``exact=False`` estimates the distinct values in one pass with no shuffle of values.
    """
    if isinstance(tables, DataFrame):
        tables = {"table": tables}
    cells = reduce(
        DataFrame.unionByName, (_cells(df, F.lit(t)) for t, df in tables.items())
    )
    return percentages(_metadata(tables).join(_count(cells, exact), _KEY, "left"))


def _count(cells: DataFrame, exact: bool) -> DataFrame:
    if exact:
        values = cells.groupBy(*_KEY, "value").agg(F.count("*").alias("n"))
        return values.groupBy(*_KEY).agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
            F.count("value").alias("unique"),
        )
    return cells.groupBy(*_KEY).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.approx_count_distinct("value", 0.02).alias("unique"),
    )


def percentages(counted: DataFrame) -> DataFrame:
    """Column records from counts; no count stands for none."""
    zero = F.lit(0).cast("bigint")
    rows, missing, unique = (F.coalesce(F.col(c), zero) for c in ("rows", "missing", "unique"))
    at_least_one = F.greatest(rows, F.lit(1))
    return counted.select(
        *_KEY,
        "name",
        "dtype",
        rows.alias("rows"),
        missing.alias("missing"),
        F.round(100 * missing / at_least_one, 2).alias("missing_pct"),
        unique.alias("unique"),
        F.round(100 * unique / at_least_one, 2).alias("unique_pct"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and cells. Counting rows needs no column of the table."""
    n = F.count("*")
    cols = len(df.columns)
    return df.agg(n.alias("rows"), F.lit(cols).alias("cols"), (n * cols).alias("cells"))


def column_missing(df: DataFrame) -> DataFrame:
    """Missing cells per column: plain counters over one scan, no values are shuffled."""
    counts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.count_if(_as_text(f).isNull()).alias("missing"),
            F.count("*").alias("rows"),
        )
        for i, f in enumerate(df.schema)
    ]
    return (
        df.agg(F.array(*counts).alias("s"))
        .select(F.inline("s"))
        .select(
            "position",
            "name",
            "missing",
            F.round(100 * F.col("missing") / F.greatest("rows", F.lit(1)), 2).alias(
                "missing_pct"
            ),
        )
    )


def grade(score: Column) -> Column:
    chain = F
    for limit, label in fixed.GRADES:
        chain = chain.when(score >= limit, label)
    return chain.otherwise(fixed.LOWEST_GRADE)


def flags() -> Column:
    """Readable findings, from the columns of the table summary below."""
    worst = F.col("worst")
    found = F.array_compact(
        F.array(
            F.when(
                F.col("total_missing") > 0,
                F.concat(
                    F.col("total_missing").cast("string"),
                    F.lit(fixed.MISSING_FLAG[0]),
                    worst["name"],
                    F.lit(fixed.MISSING_FLAG[1]),
                    worst["missing_pct"].cast("string"),
                    F.lit(fixed.MISSING_FLAG[2]),
                ),
            ),
            F.when(
                F.col("duplicate_rows") > 0,
                F.concat(F.col("duplicate_rows").cast("string"), F.lit(fixed.DUPLICATE_FLAG)),
            ),
            F.when(
                F.size("constants") > 0,
                F.concat(
                    F.lit(fixed.CONSTANT_FLAG),
                    F.array_join(F.col("constants")["name"], ", "),
                ),
            ),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fixed.NO_FLAGS)))


def table_profile(
    tables: DataFrame | Mapping[str, DataFrame],
    exact: bool = True,
    text_is_typed: bool = False,
    columns: DataFrame | None = None,
    copies: DataFrame | None = None,
) -> DataFrame:
    """One row per table: counts, the four dimensions, the score, the grade and the flags.

    Text columns count as untyped unless ``text_is_typed``. ``columns`` takes a column profile that
    is already at hand, and ``copies`` the duplicate rows by ``table_name``.
    """
    if isinstance(tables, DataFrame):
        tables = {"table": tables}
    if columns is None:
        columns = column_profile(tables, exact)
    if copies is None:
        copies = reduce(
            DataFrame.unionByName,
            (duplicate_rows(df).withColumn("table_name", F.lit(t)) for t, df in tables.items()),
        )
    return _summarise(columns, copies, text_is_typed)


def grouped_profile(
    df: DataFrame, by: str, exact: bool = True, text_is_typed: bool = False
) -> DataFrame:
    """The profile of every group of rows, such as every file of a folder, in the same two passes.

    ``by`` names the group and is not a column of the groups' tables.
    """
    group = F.col(quoted(by)).cast("string")
    fields = [f for f in df.schema if f.name != by]
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "position int, name string, dtype string",
    )
    counted = _count(_cells(df, group, without=by), exact)
    columns = percentages(counted.join(names, "position"))
    copies = (
        duplicate_groups(df, "__copies")
        .groupBy(group.alias("table_name"))
        .agg(F.sum(F.col("__copies") - 1).alias("duplicate_rows"))
    )
    return _summarise(columns, copies, text_is_typed)


def _summarise(columns: DataFrame, copies: DataFrame, text_is_typed: bool) -> DataFrame:
    """Column records and duplicate counts of each table meet in one grouping, not in a join."""
    constant = (F.col("rows") > 1) & (F.col("unique") <= 1)
    typed = F.col("dtype").isNotNull() if text_is_typed else F.col("dtype") != "string"
    is_column = F.col("position").isNotNull()
    summary = (
        columns.unionByName(copies, allowMissingColumns=True)
        .groupBy("table_name")
        .agg(
            F.max("rows").alias("rows"),
            F.count("position").cast("int").alias("cols"),
            F.sum("missing").alias("total_missing"),
            F.coalesce(F.max("duplicate_rows"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
            F.count_if(typed).alias("typed_cols"),
            F.count_if((F.col("missing_pct") == 100.0) | constant).alias("junk_cols"),
            F.max_by(
                F.struct("name", "missing_pct"),
                F.when(is_column, F.struct("missing_pct", -F.col("position"))),
            ).alias("worst"),
            # As long as the schema at most.
            F.array_sort(F.collect_list(F.when(constant, F.struct("position", "name")))).alias(
                "constants"
            ),
        )
    )

    def at_least_one(c: Column) -> Column:
        return F.greatest(c, F.lit(1))

    dims = {
        "completeness": 1 - F.col("total_missing") / at_least_one(F.col("rows") * F.col("cols")),
        "uniqueness": 1 - F.col("duplicate_rows") / at_least_one(F.col("rows")),
        "validity": F.col("typed_cols") / at_least_one(F.col("cols")),
        "consistency": 1 - F.col("junk_cols") / at_least_one(F.col("cols")),
    }
    score = reduce(lambda a, b: a + b, (w * dims[d] for d, w in fixed.WEIGHTS.items()))
    return summary.withColumn("quality_score", F.round(100 * score, 1)).select(
        "table_name",
        "rows",
        "cols",
        "duplicate_rows",
        "total_missing",
        *(F.round(c, 4).alias(d) for d, c in dims.items()),
        "quality_score",
        grade(F.col("quality_score")).alias("quality_grade"),
        flags().alias("flags"),
    )


def summary_cards(profile: DataFrame) -> DataFrame:
    """The four headline figures of each table."""
    return profile.select(
        "table_name",
        "rows",
        "cols",
        "quality_score",
        F.size(F.filter("flags", lambda f: ~F.lower(f).contains("no major")))
        .cast("bigint")
        .alias("flag_count"),
    )


def _upper_bounds(wide: DataFrame, places: list[str], n: int) -> DataFrame:
    """One row: per column a cell that no fewer than ``n`` of its cells come before or equal, null where unknown.

    Rows are dealt to ``n`` buckets, and each gives its first cell: of these ``n`` cells it is the last.
    A column has no bound if a bucket has no cell of it, as only those of a few cells do. Nothing is
    grouped, so nothing is sorted or kept.
    """
    dealt = wide.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    bounds = []
    for p in places:
        cell = F.when(F.col(p).isNotNull(), F.struct("k", F.col(p).alias("value")))
        firsts = F.array(*(F.min(F.when(F.col("bucket") == b, cell)) for b in range(n)))
        bounds.append(F.when(~F.exists(firsts, F.isnull), F.array_max(firsts)).alias(f"b{p}"))
    return dealt.agg(*bounds)


def _cells_in_order(wide: DataFrame, places: list[str], n: int) -> DataFrame:
    """(k, position, value) of the first ``n`` cells of every column at least, equal ones ``n`` times at most."""
    met = wide.crossJoin(F.broadcast(_upper_bounds(wide, places, n)))

    def early(p: str) -> Column:
        bound = F.col(f"b{p}")
        inside = bound.isNull() | (F.struct("k", F.col(p).alias("value")) <= bound)
        return F.when(F.col(p).isNotNull() & inside, F.col(p)).alias(p)

    few = met.select("k", *(early(p) for p in places)).where(F.coalesce(*map(F.col, places)).isNotNull())
    cells = few.unpivot(["k"], places, "position", "value").where(F.col("value").isNotNull())
    counted = cells.groupBy("position", "k", "value").agg(F.count("*").alias("n"))
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(n)).cast("int")))
    return counted.select("k", "position", "value", copies.alias("copy"))


def _cells_of_tasks(wide: DataFrame, places: list[str], n: int) -> DataFrame:
    """(k, position, value) of the first ``n`` cells of every column in every task, in the order of the scan."""

    def first(batches):
        wanted = [n] * len(places)
        for batch in batches:
            for i, p in enumerate(places):
                if not wanted[i]:
                    continue
                column = batch.column(p)
                at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))[: wanted[i]]
                wanted[i] -= len(at)
                found = [batch.column("k").take(pa.array(at)), pa.array([p] * len(at), pa.string()), column.take(pa.array(at))]
                yield pa.RecordBatch.from_arrays(found, ["k", "position", "value"])

    return wide.mapInArrow(first, "k long, position string, value string")


def column_samples(
    df: DataFrame, order_by: list[str] | None = None, n: int = 3
) -> DataFrame:
    """The first ``n`` present values of every column, by ``order_by`` and then by value.

    Without ``order_by`` it is the order of the scan, which for one file is the order of its lines.
    With it, one scan bounds the cells in question and a second one picks them; either way a task
    keeps a few cells per column, and no cells are sorted but those.
    """
    fields = [(i, f.name) for i, f in enumerate(df.schema)]
    key = F.monotonically_increasing_id()
    if order_by:
        key = F.struct(*(F.col(quoted(k)) for k in order_by))
    places = [str(i) for i, _ in fields]
    wide = df.select(
        key.alias("k"), *(F.col(quoted(name)).cast("string").alias(str(i)) for i, name in fields)
    )
    in_order = Window.partitionBy("position").orderBy("k", "value")
    cells = _cells_in_order(wide, places, n) if order_by else _cells_of_tasks(wide, places, n)
    samples = (
        cells.withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") <= n)
        .groupBy(F.col("position").cast("int").alias("position"))
        # At most n values per column arrive here.
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value")))["value"].alias("sample"))
    )
    names = F.array(*(F.lit(name) for _, name in fields))
    return samples.select("position", F.get(names, F.col("position")).alias("name"), "sample")
