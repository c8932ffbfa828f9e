"""Vote-based type coercion of text columns.

One aggregate job over all text columns decides their types; one lazy projection applies them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cleaning


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def without_nan(df: DataFrame, column: str) -> Column:
    """The column with NaN as null: a measure that is not a number is missing."""
    c = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalise_missing(df: DataFrame) -> DataFrame:
    """Missing-value words in text columns and NaN in float columns become null."""
    out = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StringType):
            c = cleaning.na_to_null(quoted(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class Verdict:
    """What one column's values say about its type."""

    name: str
    present: int
    numbers: int
    integers: int
    booleans: int
    dated: int
    layout: str
    dates: int

    @property
    def quorum(self) -> int:
        return max(1, int(0.9 * self.present))

    @property
    def kind(self) -> str:
        if self.present == 0:
            return "string"
        if self.booleans == self.present:
            return "boolean"
        if self.numbers >= self.quorum:
            return "bigint" if self.integers == self.numbers else "double"
        if self.dated > 0.5 * self.present and self.dates >= self.quorum:
            return "timestamp_ntz"
        return "string"

    @property
    def lost(self) -> int:
        """Values that the chosen type cannot hold and that become missing."""
        kept = {
            "string": self.present,
            "boolean": self.booleans,
            "bigint": self.numbers,
            "double": self.numbers,
            "timestamp_ntz": self.dates,
        }
        return self.present - kept[self.kind]


def ballots() -> list[Column]:
    """Counters over the columns value, number and dated of the unpivoted cells."""
    c = F.col("value")
    whole = F.when(F.col("number").isNotNull(), cleaning.is_integer(c))
    datelike = F.col("dated") & c.rlike(cleaning.DATE_START)
    layouts = [
        F.count(F.when(datelike & cleaning.may_have_layout(c, layout), cleaning.to_timestamp(c, layout)))
        for layout, _, _ in cleaning.DATE_LAYOUTS
    ]
    return [
        F.count(c),
        F.count("number"),
        F.count_if(whole),
        F.count_if(cleaning.is_boolean(c)),
        F.count_if(F.col("dated")),
        *layouts,
    ]


def looked_at() -> list[Column]:
    """The columns that ``ballots`` count, of a column ``value`` of cells."""
    c = F.col("value")
    return [c, cleaning.to_number(c).alias("number"), cleaning.looks_dated(c).alias("dated")]


def verdict(name: str, counts: list[int] | None) -> Verdict:
    """What the sums of ``ballots`` decide; None stands for a column without cells."""
    counts = counts or [0] * (5 + len(cleaning.DATE_LAYOUTS))
    dates = counts[5:]
    best = max(range(len(dates)), key=lambda k: (dates[k], -k))
    return Verdict(name, *counts[:5], layout=cleaning.DATE_LAYOUTS[best][0], dates=dates[best])


def vote(df: DataFrame, columns: list[str] | None = None) -> list[Verdict]:
    """One pass over the text columns. Only the counts, a row per column, reach the driver.

    Columns are unpivoted, so the aggregate has the same few expressions for any number of columns.
    """
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return []
    places = [str(i) for i in range(len(columns))]
    cells = df.select(
        *(F.col(quoted(name)).alias(p) for p, name in zip(places, columns))
    ).unpivot([], places, "place", "value")
    counted = cells.select("place", *looked_at()).groupBy("place").agg(F.array(*ballots()).alias("counts"))
    found = {row["place"]: row["counts"] for row in counted.collect()}
    return [verdict(name, found.get(place)) for place, name in zip(places, columns)]


def apply_verdicts(df: DataFrame, verdicts: list[Verdict]) -> DataFrame:
    """The lazy projection that casts every column to its voted type."""
    chosen = {v.name: v for v in verdicts}
    out = []
    for name in df.columns:
        c = F.col(quoted(name))
        v = chosen.get(name)
        kind = v.kind if v else "string"
        if kind == "boolean":
            c = cleaning.to_boolean(c)
        elif kind == "bigint":
            c = F.when(cleaning.is_integer(c), c.try_cast("bigint"))
        elif kind == "double":
            c = cleaning.to_number(c)
        elif kind == "timestamp_ntz":
            c = cleaning.to_timestamp(c, v.layout)
        out.append(c.alias(name))
    return df.select(*out)


def coerce_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return apply_verdicts(df, vote(df, columns))


def vote_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The vote itself as rows: counts, chosen type and values lost, per column."""
    rows = [
        (i, v.name, v.present, v.numbers, v.dated, v.dates, v.kind, v.lost)
        for i, v in enumerate(vote(df, columns))
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, name string, present bigint, numbers bigint, dated bigint, dates bigint,"
        " dtype string, lost bigint",
    )


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names with their types."""
    return df.sparkSession.createDataFrame(
        [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)],
        "position int, name string, dtype string",
    )
