"""Request routing: which file, which intent, which chart, which columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.text import strip


def file_path(prompt: Column) -> Column:
    """The path in a ``(File: path)`` suffix; null when absent or empty."""
    after = F.split_part(prompt, F.lit("(File:"), F.lit(2))
    return F.nullif(strip(F.split_part(after, F.lit(")"), F.lit(1))), F.lit(""))


def clean_question(prompt: Column) -> Column:
    """The prompt up to the file suffix."""
    return strip(F.split_part(prompt, F.lit("(File:"), F.lit(1)))


def contains_any(text: Column, words) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(word) for word in words))


def intent(prompt: Column) -> Column:
    return (
        F.when(file_path(prompt).isNull(), "chat")
        .when(contains_any(prompt, fixed.CHART_WORDS), "chart")
        .when(contains_any(prompt, fixed.QUALITY_WORDS), "quality")
        .otherwise("analysis")
    )


def wants_summary(prompt: Column) -> Column:
    return contains_any(prompt, fixed.SUMMARY_WORDS)


def chart_kind(prompt: Column) -> Column:
    return (
        F.when(contains_any(prompt, fixed.LINE_WORDS), "line")
        .when(contains_any(prompt, fixed.SCATTER_WORDS), "scatter")
        .otherwise("bar")
    )


def resolve_column(word: Column, columns: list[str]) -> Column:
    """Map a word to one of a table's columns.

    Same name in any case, else the synonyms in their order, else the first column that contains
    the word or is contained in it, else the word itself. The column list is a schema, so the
    first two steps are a literal map and the third a search in a literal array: no join.
    """
    known: dict[str, str] = {}
    for name in columns:
        known.setdefault(name.lower(), name)
    direct = dict(known)
    for said, targets in fixed.COLUMN_SYNONYMS.items():
        hit = next((known[t] for t in targets if t in known), None)
        if hit is not None:
            direct.setdefault(said, hit)
    low = F.lower(word)
    lookup = F.create_map(*(F.lit(x) for pair in direct.items() for x in pair))
    part = F.filter(
        F.array(*(F.lit(name) for name in columns)),
        lambda name: F.lower(name).contains(low) | low.contains(F.lower(name)),
    )
    return F.coalesce(F.element_at(lookup, low), F.get(part, F.lit(0)), word)


def mentioned_columns(prompt: Column, columns: list[str]) -> Column:
    """Columns named in the prompt in table order, then those reached through synonyms."""
    low = F.lower(prompt)
    none = F.array().cast("array<string>")
    firsts: dict[str, str] = {}
    for name in columns:
        firsts.setdefault(name.lower(), name)
    found = [
        F.when(low.contains(key), F.array(F.lit(name))).otherwise(none)
        for key, name in firsts.items()
    ]
    for said, targets in fixed.COLUMN_SYNONYMS.items():
        reached = [c for t in targets for c in columns if c.lower() == t]
        if reached:
            found.append(
                F.when(low.contains(said), F.array(*map(F.lit, reached))).otherwise(none)
            )
    return F.array_distinct(F.concat(*found))


def chart_axes(mentioned: Column, text_columns, number_columns, columns) -> tuple[Column, Column]:
    """x is the first mentioned text column, y the first mentioned number column.

    Without a mention the first of the kind serves, and without the kind the first and second
    columns of the table.
    """

    def pick(kind: list[str], position: int) -> Column:
        fallback = kind[0] if kind else columns[min(position, len(columns) - 1)]
        if not kind:
            return F.lit(fallback)
        return F.coalesce(
            F.get(F.filter(mentioned, lambda c: c.isin(kind)), F.lit(0)), F.lit(fallback)
        )

    return pick(list(text_columns), 0), pick(list(number_columns), 1)
