"""Native column expressions used on raw and windowed rows."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Recode maps for the card and sale flags. A value outside a map becomes null.
USE_CHIP = {"Chip Transaction": 1, "Swipe Transaction": 0, "Online": 0}
YES_NO = {"Yes": 1, "No": 0}

NO_ERROR = "No Error"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_row(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct column: a scalar subquery, run once and shared."""
    return df.select(F.struct("*")).scalar()


def money(c: Column | str, lenient: bool = False) -> Column:
    """``$12.31`` to 12.31. Junk raises (ANSI cast) unless ``lenient``, which gives null."""
    bare = F.replace(_col(c).cast("string"), F.lit("$"), F.lit(""))
    return bare.try_cast("double") if lenient else bare.cast("double")


def recode(c: Column | str, mapping: Mapping[str, int]) -> Column:
    c = _col(c)
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out


def is_yes(c: Column | str) -> Column:
    return F.when(_col(c) == "Yes", 1).otherwise(0)


def online_sales(city: Column | str) -> Column:
    return F.when(F.lower(_col(city)) == "online", "Yes").otherwise("No")


def sale_city(city: Column | str) -> Column:
    return F.when(F.lower(_col(city)) == "online", "Online").otherwise(_col(city))


def sale_country(state: Column | str) -> Column:
    state = _col(state)
    return F.coalesce(F.when(F.length(state) == 2, "United States").otherwise(state), F.lit("Online"))


def chip_flag(has_chip: Column | str) -> Column:
    return F.when(F.lower(_col(has_chip)) == "yes", "Yes").otherwise("No")


def capped_ratio(num: Column, den: Column, cap: float = 100.0) -> Column:
    """``num / den``, ``cap`` when the denominator is 0, and never above ``cap``."""
    return F.when(den == 0, F.lit(cap)).otherwise(F.least(F.try_divide(num, den), F.lit(cap)))


def ratio_zero_as_one(num: Column, den: Column) -> Column:
    return num / F.when(den == 0, F.lit(1)).otherwise(den)


# Ordered replacements that turn a feature name into a formula-safe name.
NAME_RULES = (("-", "_"), ("&_", ""), ("__", ""), ("___", ""), (",", ""), ("(", ""), (")", ""), ("'", ""))


def clean_name(name: str) -> str:
    for old, new in NAME_RULES:
        name = name.replace(old, new)
    return name


_WINDOW = re.compile(r"^\s*(\d*)\s*(mo|min|m|T|t|h|H|d|D|w|W)\s*$")
_MINUTES = {"m": 1, "min": 1, "t": 1, "h": 60, "d": 1440}


def parse_window(spec: str) -> tuple[str, int]:
    """``'360m'`` to ``('minutes', 360)``; calendar units stay ``('week', n)`` / ``('month', n)``."""
    match = _WINDOW.match(spec) if isinstance(spec, str) else None
    if not match:
        raise ValueError(f"not a window specification: {spec!r}")
    n, unit = int(match.group(1) or 1), match.group(2)
    if n < 1:
        raise ValueError(f"a window must be longer than zero: {spec!r}")
    if unit == "mo":
        return "month", n
    unit = unit.lower()
    if unit == "w":
        return "week", n
    return "minutes", n * _MINUTES[unit]


def truncate(c: Column | str, spec: str) -> Column:
    """Start of the tumbling window that holds ``c``.

    Minutes, hours and days are counted from the epoch; weeks start on Monday; months on the first.
    The input type is kept (a zone-free timestamp stays zone-free); a null gives null for every unit.
    """
    c = _col(c)
    unit, n = parse_window(spec)
    if unit != "month":
        # a window drops rows without a time, so a stand-in takes their place first; 1970-01-05 is a Monday
        present = F.coalesce(c, F.lit("1970-01-01").cast("timestamp_ntz"))
        days = {"startTime": "4 days"} if unit == "week" else {}
        start = F.window(present, f"{7 * n} days" if unit == "week" else f"{n} minutes", **days)["start"]
        return F.when(c.isNotNull(), start)
    if n == 1:
        return F.date_trunc("month", c).cast("timestamp_ntz")
    months = (F.year(c) - 1970) * 12 + F.month(c) - 1
    first = months - F.pmod(months, F.lit(n))
    return F.add_months(F.lit("1970-01-01").cast("date"), first).cast("timestamp_ntz")


def epoch_minute(c: Column | str) -> Column:
    """Whole minutes since 1970 of a zone-free timestamp, from its calendar parts: independent of the session's zone."""
    c = _col(c)
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
