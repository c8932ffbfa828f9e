"""The quality report as text lines and as markdown, from the structured profile.

A report has as many lines as the table has columns and flags, so it is built as one array in one
row and unfolded to (line_no, line). Personal data in it is redacted.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.text import redact_personal_data
from plumbline.operators.analysis import breakdown, missing_alert, numeric_summary
from plumbline.operators.coercion import number_columns, quoted
from plumbline.operators.profile import (
    column_missing,
    column_profile,
    column_samples,
    table_profile,
)

DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency")


def percent(share: Column) -> Column:
    return F.concat(F.bround(100 * share, 0).cast("int").cast("string"), F.lit("%"))


def _score() -> Column:
    return F.concat(
        F.col("quality_score").cast("string"), F.lit("/100  —  "), F.col("quality_grade")
    )


def _size() -> Column:
    return F.concat(
        F.lit("Rows: "),
        F.format_number("rows", 0),
        F.lit(" | Columns: "),
        F.col("cols").cast("string"),
    )


def _origin(source: Mapping) -> str:
    text = (
        f"Encoding: {source.get('encoding', 'n/a')} | "
        f"Delimiter: {source.get('delimiter', 'n/a')!r} | Size: {source.get('bytes', 0):,} bytes"
    )
    return text + ("  [SAMPLED]" if source.get("sampled") else "")


def _facts(df: DataFrame, text_is_typed: bool, samples: DataFrame | None = None) -> DataFrame:
    """One row: the table profile with its column records as an array in table order."""
    columns = column_profile(df)
    records, fields = columns, ["position", "name", "dtype", "missing_pct", "unique"]
    if samples is not None:
        records = columns.join(samples.select("position", "sample"), "position", "left")
        fields.append("sample")
    # As long as the schema.
    listed = F.array_sort(F.collect_list(F.struct(*fields))).alias("columns")
    profile = table_profile(df, text_is_typed=text_is_typed, columns=columns)
    return profile.join(records.groupBy("table_name").agg(listed), "table_name")


def _unfold(facts: DataFrame, lines: Column) -> DataFrame:
    exploded = facts.select(F.posexplode(lines).alias("line_no", "line"))
    return exploded.select("line_no", redact_personal_data(F.col("line")).alias("line"))


def _array(*texts) -> Column:
    return F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts))


def quality_report_lines(
    df: DataFrame,
    order_by: list[str] | None = None,
    source: Mapping | None = None,
    text_is_typed: bool = False,
) -> DataFrame:
    """The plain-text report. ``order_by`` defines which values are the first ones to show."""

    def column_line(c: Column) -> Column:
        return F.concat(
            F.lit("  "),
            c["name"],
            F.lit(" :: "),
            c["dtype"],
            F.lit(" | missing "),
            c["missing_pct"].cast("string"),
            F.lit("% | unique "),
            c["unique"].cast("string"),
            F.lit(" | e.g. "),
            F.when(F.size(c["sample"]) > 0, F.array_join(c["sample"], ", ")).otherwise("—"),
        )

    dims = F.concat_ws(
        "  ", *(F.concat(F.lit(f"{d}="), percent(F.col(d))) for d in DIMENSIONS)
    )
    head = [fixed.QUALITY_TITLE, "=" * 32]
    if source:
        if source.get("file"):
            head.append(f"File: {source['file']}")
        if source.get("sheet"):
            head.append(f"Sheet: {source['sheet']}")
        head.append(_origin(source))
    lines = F.concat(
        _array(
            *head,
            _size(),
            "",
            F.concat(F.lit("DATA QUALITY SCORE: "), _score()),
            F.concat(F.lit("  "), dims),
            "",
            "SCHEMA",
            "-" * 6,
        ),
        F.transform("columns", column_line),
        _array("", "FLAGS", "-" * 5),
        F.transform("flags", lambda f: F.concat(F.lit("  - "), f)),
    )
    return _unfold(_facts(df, text_is_typed, column_samples(df, order_by)), lines)


def quality_report_markdown(
    df: DataFrame, source: Mapping | None = None, text_is_typed: bool = False
) -> DataFrame:
    """The report as markdown: score heading, dimensions, schema table, flags."""

    def column_line(c: Column) -> Column:
        return F.concat(
            F.lit("| "),
            c["name"],
            F.lit(" | `"),
            c["dtype"],
            F.lit("` | "),
            c["missing_pct"].cast("string"),
            F.lit("% | "),
            c["unique"].cast("string"),
            F.lit(" |"),
        )

    dims = F.concat_ws(
        " · ",
        *(F.concat(F.lit(f"**{d.title()}** "), percent(F.col(d))) for d in DIMENSIONS),
    )
    about = [F.lit(source["file"])] if source and source.get("file") else []
    about += [F.lit(_origin(source))] if source else []
    lines = F.concat(
        _array("### Data Quality Report", "", F.concat(F.lit("## "), _score()), dims, ""),
        _array(F.concat_ws("  |  ", *about, _size()), "", "**Schema**", ""),
        _array("| Column | Type | Missing | Unique |", "|---|---|---|---|"),
        F.transform("columns", column_line),
        _array("", "**Data Quality Flags**", ""),
        F.transform("flags", lambda f: F.concat(F.lit("- "), f)),
        _array(""),
    )
    return _unfold(_facts(df, text_is_typed), lines)


def _two_places(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("nan")).otherwise(F.format_string("%.2f", c))


def analysis_report_lines(
    df: DataFrame,
    product: str = "Product",
    region: str = "Region",
    revenue: str = "Revenue",
    units: str | None = "Units",
    file: str | None = None,
) -> DataFrame:
    """The analysis report as text lines, ordered by (block, place, -amount, line).

    ``file`` is the name that the report gives for the table's source.
    Breakdowns have a line per group and may be long, so lines are never gathered into one cell.
    """
    spark = df.sparkSession
    numbers = number_columns(df)

    def fixed_lines(block: int, *lines: str) -> DataFrame:
        rows = [(block, i, None, line) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "block int, place int, amount double, line string")

    def line(block: int, place, text: Column, amount: Column | None = None) -> list[Column]:
        return [
            F.lit(block).alias("block"),
            (F.lit(place) if isinstance(place, int) else place).alias("place"),
            (F.lit(None).cast("double") if amount is None else amount).alias("amount"),
            text.alias("line"),
        ]

    missing = column_missing(df)
    count = lambda c: F.col(c).cast("string")
    in_order = F.array_sort(F.collect_list(F.struct("position", "name", "missing")))
    listed = F.array_join(
        F.transform(
            in_order,
            lambda c: F.concat(F.lit("'"), c["name"], F.lit("': "), c["missing"].cast("string")),
        ),
        ", ",
    )
    totals = missing.agg(F.sum("missing").alias("total"), listed.alias("listed"))
    types = ", ".join(f"'{n}': '{t}'" for n, t in df.dtypes)
    parts = [
        fixed_lines(0, fixed.ANALYSIS_TITLE, "=" * 18, *([f"File: {file}"] if file else [])),
        df.agg(F.count("*").alias("n")).select(
            *line(1, 0, F.concat(F.lit("Rows: "), count("n")))
        ),
        fixed_lines(
            2,
            f"Columns: {len(df.columns)}",
            f"Column Names: {', '.join(df.columns)}",
            f"Data Types: {{{types}}}",
        ),
        totals.select(
            *line(3, 0, F.concat(F.lit("Missing Values (Total): "), count("total")))
        ),
        totals.select(
            *line(
                4, 0, F.concat(F.lit("Missing Breakdown: {"), F.col("listed"), F.lit("}"))
            )
        ),
        fixed_lines(5, "", "NUMERIC SUMMARY", "-" * 15),
    ]
    if numbers:
        stats = F.concat_ws(
            ", ",
            *(
                F.concat(F.lit(f"{stat}="), _two_places(F.col(stat)))
                for stat in ("mean", "std", "min", "max")
            ),
        )
        parts.append(
            numeric_summary(df, numbers, quartiles=None).select(
                *line(6, F.col("position"), F.concat(F.lit("  "), F.col("name"), F.lit(": "), stats))
            )
        )
    else:
        parts.append(fixed_lines(6, "No numeric columns detected."))
    sections = (("PRODUCT-LEVEL BREAKDOWN", product), ("REGION-LEVEL BREAKDOWN", region))
    for k, (title, key) in enumerate(sections):
        if key not in df.columns or revenue not in df.columns:
            continue
        extra = units if units in df.columns else None
        sold = F.concat(
            F.lit("  "),
            F.col(quoted(key)).cast("string"),
            F.lit(": $"),
            F.format_number(F.bround("total", 0), 0),
            F.lit(" revenue"),
        )
        if extra:
            sold = F.concat(sold, F.lit(", "), F.col("units").cast("string"), F.lit(" units"))
        parts.append(fixed_lines(7 + 2 * k, "", title, "-" * 30))
        parts.append(
            breakdown(df, key, revenue, extra, ordered=False).select(*line(8 + 2 * k, 0, sold, F.col("total")))
        )
    parts.append(fixed_lines(11, "", "DATA QUALITY FLAGS", "-" * 18))
    parts.append(missing_alert(df).select(*line(12, 0, F.col("alert"))))
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("line", redact_personal_data(F.col("line")))
        .orderBy("block", "place", F.desc("amount"), "line")
    )
