"""Text guardrails as Column expressions: injection, personal data, unsafe output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed

# Unicode character classes, and a dot that stops at a line feed only.
UNICODE = "(?Ud)"
UNICODE_ANY_CASE = "(?iUd)"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def injection_match(text: Column) -> Column:
    """The text matched by the first pattern in list order that occurs, else null."""
    return F.coalesce(
        *(
            F.nullif(F.regexp_extract(text, UNICODE_ANY_CASE + pattern, 0), F.lit(""))
            for pattern in fixed.INJECTION_PATTERNS
        )
    )


def injection_reason(text: Column, match: Column) -> Column:
    """Why a prompt is accepted or refused, given its ``injection_match``."""
    return (
        F.when(text.isNull() | (text == ""), fixed.EMPTY_INPUT)
        .when(
            match.isNotNull(),
            F.concat(
                F.lit(fixed.INJECTION_FOUND[0]), match, F.lit(fixed.INJECTION_FOUND[1])
            ),
        )
        .otherwise(fixed.INPUT_SAFE)
    )


def is_safe(text: Column) -> Column:
    """True for a non-empty text without any injection pattern."""
    any_hit = reduce(
        lambda a, b: a | b,
        (text.rlike(UNICODE_ANY_CASE + pattern) for pattern in fixed.INJECTION_PATTERNS),
    )
    return F.coalesce((text != "") & ~any_hit, F.lit(False))


# Where an address can start: after the last match, or not in the middle of its own characters. This
# changes no match, but without it every position of a long unbroken run of characters would be
# tried to the end of the run.
_STARTS = {"email": r"(?:\G|(?<![a-zA-Z0-9._%+-]))"}


def _personal_data():
    for kind, pattern, placeholder in fixed.PERSONAL_DATA:
        yield kind, UNICODE + _STARTS.get(kind, "") + pattern, placeholder


def redact_personal_data(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then social security numbers."""
    for _, pattern, placeholder in _personal_data():
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def count_personal_data(df: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """Matches per kind, each counted on the text that earlier kinds leave behind.

    Each step is a column of its own, so that no replacement runs twice.
    """
    step = df.select(*keep, F.col(text).alias("__left"))
    for kind, pattern, placeholder in _personal_data():
        left = F.col("__left")
        step = step.withColumn(kind, F.regexp_count(left, F.lit(pattern))).withColumn(
            "__left", F.regexp_replace(left, pattern, placeholder)
        )
    return step.drop("__left")


def is_image(text: Column) -> Column:
    return F.startswith(text, F.lit(fixed.IMAGE_PREFIX))


def without_unsafe(text: Column) -> Column:
    """Each unsafe pattern replaced in turn by the marker; image payloads pass through."""
    cleaned = text
    for pattern in fixed.UNSAFE_PATTERNS:
        cleaned = F.regexp_replace(cleaned, UNICODE_ANY_CASE + pattern, fixed.UNSAFE_MARKER)
    return F.when(is_image(text), text).otherwise(cleaned)


def sanitize(
    df: DataFrame, text: str = "text", cleaned: str = "cleaned", flagged: str = "was_flagged"
) -> DataFrame:
    """Add the sanitised text and whether an unsafe pattern was found.

    The first step is a column of its own, so that the flag compares with it instead of running
    the eight replacements a second time. Personal data is removed but raises no flag.
    """
    step = df.withColumn(cleaned, without_unsafe(F.col(text)))
    return step.withColumn(
        flagged, F.coalesce(F.col(cleaned) != F.col(text), F.lit(False))
    ).withColumn(
        cleaned,
        F.when(is_image(F.col(text)), F.col(text)).otherwise(
            redact_personal_data(F.col(cleaned))
        ),
    )


def response_summary(text: Column, length: int = 200) -> Column:
    """What session memory keeps of a response: its start, or a note for charts."""
    return F.when(is_image(text), fixed.CHART_SUMMARY).otherwise(F.substring(text, 1, length))


def safe_session_id(session: Column) -> Column:
    """Letters, digits, minus and underscore only."""
    return F.regexp_replace(session, r"[^\p{L}\p{N}_-]", "")


def cache_key(prompt: Column, path: Column) -> Column:
    return F.md5(F.concat(prompt, F.lit(":"), F.coalesce(path, F.lit(""))))
