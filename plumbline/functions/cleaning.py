"""Raw text to typed values: missing-value words, numbers, booleans, dates, headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"

# How a text of any date layout starts.
DATE_START = r"^([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]|[0-9]{1,2}[- ][A-Za-z]{3}|[A-Za-z]{3,9}\.?[- ][0-9])"

# The months, by the letters that tell them apart.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = "((?:" + "|".join(MONTHS) + r")[A-Za-z]{0,6})\.?"
_CLOCK = r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)"

# Date layouts: name, pattern of the whole text, rewrite to year-month-day. One layout serves a
# whole column. Earlier ones win ties, so month comes before day where both would do.
DATE_LAYOUTS = (
    ("iso", r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", "$1-$2-$3"),
    (
        "iso_time",
        r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})[ T]([0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)[0-9]{0,3}$",
        "$1-$2-$3 $4",
    ),
    ("ymd_slash", r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", "$1-$2-$3"),
    ("mdy_slash", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2"),
    ("dmy_slash", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$2-$1"),
    ("mdy_dash", r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", "$3-$1-$2"),
    ("dmy_dash", r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", "$3-$2-$1"),
    (
        "mdy_slash_time",
        r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)$",
        "$3-$1-$2 $4",
    ),
    (
        "dmy_slash_time",
        r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)$",
        "$3-$2-$1 $4",
    ),
    ("dmy_dot_time", rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}) {_CLOCK}$", "$3-$2-$1 $4"),
    # A clock of twelve hours keeps its half of the day, and a zone its offset, for later.
    ("mdy_slash_half", rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}) {_CLOCK} ?([AaPp])[Mm]$", "$3-$1-$2 $4|$5"),
    ("dmy_slash_half", rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}) {_CLOCK} ?([AaPp])[Mm]$", "$3-$2-$1 $4|$5"),
    (
        "iso_zone",
        r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})[ T]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)"
        r"[0-9]{0,3} ?(?:[Zz]|([+-][0-9]{2}):?([0-9]{2}))$",
        "$1-$2-$3 $4|$5|$6",
    ),
    # Month names, in either order, with or without a time.
    ("dmy_name", rf"(?i)^([0-9]{{1,2}})[- ]{_MONTH}[- ,]+([0-9]{{4}})(?: {_CLOCK})?$", "$3-$2-$1 $4"),
    ("mdy_name", rf"(?i)^{_MONTH}[- ]([0-9]{{1,2}}),?[- ]([0-9]{{4}})(?:,? {_CLOCK})?$", "$3-$1-$2 $4"),
)


def _signs(name: str) -> str:
    """Signs that every text of a layout has: a cheap look before its pattern."""
    slash = "/" if "slash" in name else ""
    return slash + (":" if name.endswith(("_time", "_half", "_zone")) else "")


_NA_LIST = ", ".join(f"'{token}'" for token in fixed.NA_TOKENS)


def na_to_null(name: str) -> Column:
    """The text column of that name with missing-value words as null."""
    return F.expr(f"CASE WHEN {name} NOT IN ({_NA_LIST}) THEN {name} END")


def _may_be_number(text: Column) -> Column:
    """A cheap look at the first character: blanks, signs, the dot and digits sort before a colon."""
    return text < ":"


def to_number(text: Column) -> Column:
    """Double, or null when the text is not a plain number.

    The pattern keeps out what the cast alone would let in (a type suffix as in ``5d``). A number
    too large for a double is missing, while a text that says infinity is infinite.
    """
    value = text.try_cast("double")
    finite = F.when(text.rlike(_NUMBER) & (F.abs(value) < float("inf")), value)
    infinite = F.when(text.rlike(_INFINITY), value)
    return (
        F.when(_may_be_number(text), F.coalesce(finite, infinite))
        .when(F.lower(F.substring(text, 1, 1)) == "i", infinite)
    )


def is_integer(text: Column) -> Column:
    return _may_be_number(text) & text.rlike(_INTEGER) & text.try_cast("bigint").isNotNull()


def is_boolean(text: Column) -> Column:
    return text.isin(*fixed.TRUE_TOKENS, *fixed.FALSE_TOKENS)


def to_boolean(text: Column) -> Column:
    return F.when(is_boolean(text), text.isin(*fixed.TRUE_TOKENS))


def looks_dated(text: Column) -> Column:
    return text.contains("-") | text.contains("/") | text.contains(":")


def may_have_layout(text: Column, layout: str) -> Column:
    """Whether the text has the signs that every text of the layout has."""
    return reduce(Column.__and__, (text.contains(sign) for sign in _signs(layout)), F.lit(True))


def to_timestamp(text: Column, layout: str) -> Column:
    """Timestamp without time zone in one layout; null for any other text.

    Rewriting to the standard form and casting needs no session time zone, so an hour that
    daylight saving skips somewhere is not lost.
    """
    pattern, rewrite = next((p, r) for name, p, r in DATE_LAYOUTS if name == layout)
    plain = F.regexp_replace(text, pattern, rewrite)
    if layout.endswith("_name"):
        plain = _month_to_number(plain)
    if layout.endswith("_half"):
        stamp = _with_half_day(plain)
    elif layout.endswith("_zone"):
        stamp = _without_zone(plain)
    else:
        stamp = F.rtrim(plain).try_cast("timestamp_ntz")
    return F.when(text.rlike(pattern), stamp)


def _month_to_number(plain: Column) -> Column:
    """Year, month by name, day and time as a standard text."""
    name = F.lower(F.regexp_extract(plain, "-([A-Za-z]+)-", 1))
    numbers = F.create_map(*(F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, str(i))))
    number = F.element_at(numbers, F.substring(name, 1, 3))
    return F.concat_ws(
        "-", F.substring_index(plain, "-", 1), number, F.regexp_extract(plain, "-[A-Za-z]+-(.*)$", 1)
    )


def _with_half_day(plain: Column) -> Column:
    """Noon is 12 PM, midnight 12 AM; hours beyond 12 are none of this clock."""
    stamp = F.substring_index(plain, "|", 1).try_cast("timestamp_ntz")
    later = F.lower(F.substring_index(plain, "|", -1)) == "p"
    hour = F.hour(stamp)
    shift = F.when(later & (hour < 12), 12).when(~later & (hour == 12), -12).otherwise(0)
    return F.when(hour.between(1, 12), stamp + F.make_dt_interval(hours=shift))


def _without_zone(plain: Column) -> Column:
    """The moment on the clock of UTC."""
    parts = F.split(plain, r"\|")
    hours = F.coalesce(parts[1].try_cast("int"), F.lit(0))
    minutes = F.coalesce(parts[2].try_cast("int"), F.lit(0))
    minutes = F.when(F.startswith(parts[1], F.lit("-")), -minutes).otherwise(minutes)
    return parts[0].try_cast("timestamp_ntz") - F.make_dt_interval(hours=hours, mins=minutes)


def header_names(raw: list[str | None]) -> list[str]:
    """Strip, name the blanks by position, and number the repeats."""
    taken: set[str] = set()
    names = []
    for position, name in enumerate(raw):
        base = (name or "").strip() or f"Unnamed: {position}"
        candidate, repeat = base, 0
        while candidate in taken:
            repeat += 1
            candidate = f"{base}.{repeat}"
        taken.add(candidate)
        names.append(candidate)
    return names
