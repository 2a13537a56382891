"""Calendar expressions: US federal holidays without a lookup table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values. Weekdays count from Monday = 0.
# Holidays on a fixed day, observed on the nearest weekday: (month, day, first year or None).
FIXED_HOLIDAYS = (
    (1, 1, None),      # New Year's Day
    (6, 19, 2021),     # Juneteenth
    (7, 4, None),      # Independence Day
    (11, 11, None),    # Veterans Day
    (12, 25, None),    # Christmas Day
)
# Holidays on the n-th weekday of a month: (month, weekday, first day it can fall on, first year or None).
FLOATING_HOLIDAYS = (
    (1, 0, 15, 1986),   # Martin Luther King Jr. Day, third Monday
    (2, 0, 15, None),   # Washington's Birthday, third Monday
    (5, 0, 25, None),   # Memorial Day, last Monday
    (9, 0, 1, None),    # Labor Day, first Monday
    (10, 0, 8, None),   # Columbus Day, second Monday
    (11, 3, 22, None),  # Thanksgiving, fourth Thursday
)


def is_us_federal_holiday(column: str) -> Column:
    """True on the *observed* date of a federal holiday: a Saturday moves to Friday, a Sunday to Monday."""
    day = f"to_date({column})"
    tests = []
    for month, dom, since in FIXED_HOLIDAYS:
        # the holiday itself on a weekday, the Friday before a Saturday, the Monday after a Sunday
        for shift, on in ((0, "< 5"), (1, "= 4"), (-1, "= 0")):
            actual = f"date_add({day}, {shift})"
            test = f"month({actual}) = {month} AND day({actual}) = {dom} AND weekday({day}) {on}"
            tests.append(test + (f" AND year({actual}) >= {since}" if since else ""))
    for month, on, first, since in FLOATING_HOLIDAYS:
        test = f"month({day}) = {month} AND weekday({day}) = {on} AND day({day}) BETWEEN {first} AND {first + 6}"
        tests.append(test + (f" AND year({day}) >= {since}" if since else ""))
    return F.expr(" OR ".join(f"({t})" for t in tests))
