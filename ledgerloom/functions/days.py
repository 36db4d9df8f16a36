"""Calendar days written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ISO = r"^\s*\d{4}-\d{2}-\d{2}(?:[T\s].*)?$"
_YEAR_FIRST = r"^\s*(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})(?:[T\s].*)?$"
_MONTH_FIRST = r"^(?i)\s*([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\s*$"
_DAY_FIRST = r"^(?i)\s*(\d{1,2})(?:st|nd|rd|th)?(?:\s+|-)([a-z]{3})[a-z]*\.?,?(?:\s+|-)(\d{4})\s*$"


def month_number(name: Column) -> Column:
    """1 to 12 of an English month name, null of anything else."""
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(name), 1, 3))
    return F.when(place > 0, place)


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return text.try_cast("date")


def calendar_day(text: Column) -> Column:
    """The date a text states; null for null, blank and unreadable text.

    Read are ``2026-08-12``, ``2026/8/12``, ``2026.08.12``, ``20260812`` (each with any time of day
    behind a ``T`` or blank, which is ignored), ``Aug 12, 2026``, ``August 12 2026`` and
    ``12 Aug 2026``.  Days that the calendar lacks are unreadable.
    """
    t = F.trim(text)
    first = F.split(F.regexp_replace(t, _YEAR_FIRST, "$1|$3|$4"), r"\|")
    month_first = F.split(F.regexp_replace(t, _MONTH_FIRST, "$3|$1|$2"), r"\|")
    day_first = F.split(F.regexp_replace(t, _DAY_FIRST, "$3|$2|$1"), r"\|")
    named = lambda p: _day(p.getItem(0), month_number(p.getItem(1)).cast("string"), p.getItem(2))
    return (
        F.when(t.rlike(_ISO), F.substring(F.ltrim(t), 1, 10).try_cast("date"))
        .when(t.rlike(_YEAR_FIRST), _day(first.getItem(0), first.getItem(1), first.getItem(2)))
        .when(t.rlike(_MONTH_FIRST), named(month_first))
        .when(t.rlike(_DAY_FIRST), named(day_first))
    )
