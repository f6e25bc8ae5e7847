"""Dates and periods from text, word by word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: A month's name, its first three letters, or Sept.
MONTH = "(" + "|".join([*_FULL, "sept", *MONTHS]) + ")"
#: Two-digit years from here on are of the last century.
PIVOT = 69
#: Years that a period may have.
FIRST_YEAR, LAST_YEAR = 1990, 2100


def _found(col: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name in lower case, by its first three letters; null for other words."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3)).cast("int")
    return F.when(name.rlike(f"^{MONTH}$") & (at > 0), at)


def full_year(digits: Column) -> Column:
    year = digits.try_cast("int")
    return F.when(F.length(digits) > 2, year).otherwise(year + F.when(year < PIVOT, 2000).otherwise(1900))


def to_iso_date(col: Column) -> Column:
    """Date of a text that is one, day first; null where it is none.

    Year first: ``2023-04-03``, with ``-``, ``/`` or ``.``.  Day first: one or two digits, then the month as a number or a name of any
    length and case, then two or four digits of the year, parted by spaces, dots, dashes, slashes or commas; ordinals such as ``3rd``
    count as numbers.  Month first: only by name.  If the second number can be no month but the first can, they change places.  A time
    of day may follow.  Two digits are 2000 to 2068 or 1969 to 1999.
    """
    low = F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))
    text = F.regexp_replace(low, r"\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    time = r"(?:[t ,]+\d{1,2}:\d{2}.*)?$"
    year_first = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){time}"
    numbers = rf"^(\d{{1,2}}) ?[-/. ] ?(\d{{1,2}}) ?[-/. ] ?(\d{{4}}|\d{{2}}){time}"
    named = rf"^(\d{{1,2}})[-/., ]*{MONTH}[-/., ]*(\d{{4}}|\d{{2}}){time}"
    month_first = rf"^{MONTH}[-/., ]*(\d{{1,2}})[-/., ]+(\d{{4}}){time}"
    a, b = (_found(text, numbers, i).try_cast("int") for i in (1, 2))
    swap = (b > 12) & (a <= 12)
    year = F.coalesce(_found(text, year_first, 1).try_cast("int"), *[full_year(_found(text, p, 3)) for p in (numbers, named, month_first)])
    month = F.coalesce(
        _found(text, year_first, 2).try_cast("int"), F.when(swap, a).otherwise(b), month_number(_found(text, named, 2)), month_number(_found(text, month_first, 1))
    )
    day = F.coalesce(
        _found(text, year_first, 3).try_cast("int"), F.when(swap, b).otherwise(a), *[_found(text, p, i).try_cast("int") for p, i in ((named, 1), (month_first, 2))]
    )
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))


def _bounded(year: Column) -> Column:
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), year)


def period_token(col: Column) -> Column:
    """First day of the month that a whole text names, as ``2024-03-01``; null where it is anything else.

    ``Mar 24``, ``march_2024``, ``Sept-2024``: a word that begins with a month's name, and two or four digits of a year (two: 2000 on).  Or a time stamp
    with all its parts, ``2024-03-05 00:00:00``, whatever stands between the numbers.  A month without a year is no period; nor is a year
    outside 1990 to 2100.
    """
    text = F.regexp_replace(F.lower(F.trim(col)), r"[\s:-]", "_")
    stamp = r"^(\d{4})_(\d{2})_\d{2}_\d{2}_\d{2}_\d{2}$"
    # a three-digit year would be out of bounds anyhow
    word = r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z_]*?_*(\d{2}|\d{4})$"
    digits = _found(text, word, 2)
    year = F.coalesce(_found(text, stamp, 1).try_cast("int"), F.when(F.length(digits) == 2, digits.try_cast("int") + 2000).otherwise(digits.try_cast("int")))
    month = F.coalesce(_found(text, stamp, 2).try_cast("int"), month_number(_found(text, word, 1)))
    whole = F.when(month.between(1, 12), F.format_string("%04d-%02d-01", _bounded(year), month))
    return F.when(_bounded(year).isNotNull(), whole)


def period_key(col: Column) -> Column:
    """Period that the words of a text name: ``2024-03``, ``2024-Q1`` or ``2024``; null without one.

    An ISO month, else a month's name with a year of two or four digits after it, else a quarter (``Q1``) with a year anywhere, else a year.  Only
    whole words count (``decimal 2024`` is a year), and only years from 1990 to 2100.
    """
    low = F.lower(col)
    iso = rf"(?<!\d)(\d{{4}})-(0[1-9]|1[0-2])(?!\d)"
    named = rf"\b{MONTH}[\s_.,-]*(\d{{4}}|\d{{2}})(?!\d)"
    iso_year, iso_month = _bounded(_found(low, iso, 1).try_cast("int")), _found(low, iso, 2)
    digits, month = _found(low, named, 2), month_number(_found(low, named, 1))
    named_year = _bounded(F.when(F.length(digits) == 2, digits.try_cast("int") + 2000).otherwise(digits.try_cast("int")))
    quarter = _found(low, r"\bq([1-4])\b", 1)
    year = _bounded(_found(low, r"(?<!\d)(19[0-9]{2}|20[0-9]{2}|2100)(?!\d)", 1).try_cast("int")).cast("string")
    return (
        F.when(iso_year.isNotNull(), F.concat_ws("-", iso_year.cast("string"), iso_month))
        .when(named_year.isNotNull() & month.isNotNull(), F.format_string("%04d-%02d", named_year, month))
        .when(quarter.isNotNull() & year.isNotNull(), F.concat(year, F.lit("-Q"), quarter))
        .when(year.isNotNull(), year)
    )


def period_type(col: Column) -> Column:
    """month, quarter or year, from what :func:`period_key` gives."""
    key = period_key(col)
    return F.when(key.rlike(r"^\d{4}-\d{2}$"), "month").when(key.rlike("-Q"), "quarter").when(key.isNotNull(), "year")
