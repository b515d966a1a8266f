"""Dates from text, URLs and page metadata."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gumshoe.functions.urls import url_path

# Month names, English and French, by month number.
MONTHS = {
    1: ("jan", "january", "janvier"),
    2: ("feb", "february", "février", "fevrier"),
    3: ("mar", "march", "mars"),
    4: ("apr", "april", "avril"),
    5: ("may", "mai"),
    6: ("jun", "june", "juin"),
    7: ("jul", "july", "juillet"),
    8: ("aug", "august", "août", "aout"),
    9: ("sep", "sept", "september", "septembre"),
    10: ("oct", "october", "octobre"),
    11: ("nov", "november", "novembre"),
    12: ("dec", "december", "décembre", "decembre"),
}
_MONTH = r"([\p{L}]+)"


def parse_date(text: Column, today: Column | None = None) -> Column:
    """ISO text or the literal `now` to a date."""
    today = F.current_date() if today is None else today
    return F.when(text == "now", today).otherwise(F.try_to_date(text, "yyyy-MM-dd"))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, null when the parts are not one."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for number, names in MONTHS.items() for n in names for x in (n, str(number))]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def _first_plausible(path: Column, pattern: str, with_day: bool, latest: int) -> Column:
    def to_date(hit: Column) -> Column:
        day = F.regexp_extract(hit, pattern, 3) if with_day else F.lit("1")
        return _date(F.regexp_extract(hit, pattern, 1), F.regexp_extract(hit, pattern, 2), day)

    days = F.transform(F.regexp_extract_all(path, F.lit(pattern), F.lit(0)), to_date)
    good = F.filter(days, lambda d: d.isNotNull() & F.year(d).between(1990, latest))
    return F.try_element_at(good, F.lit(1))


def url_date(url: Column, this_year: int | None = None) -> Column:
    """Date in a URL path: y/m/d, else yyyymmdd, else y/m; '' when none is plausible."""
    latest = (this_year or datetime.date.today().year) + 1
    path = url_path(url)
    out = None
    for sep in ("[/-]", ""):
        digits = "{1,2}" if sep else "{2}"
        pattern = rf"(?<!\d)(\d{{4}}){sep}(\d{digits}){sep}(\d{digits})(?!\d)"
        first = F.date_format(_first_plausible(path, pattern, True, latest), "yyyy-MM-dd")
        out = first if out is None else F.coalesce(out, first)
    months = _first_plausible(path, r"(?<!\d)(\d{4})[/-](\d{1,2})(?!\d)", False, latest)
    return F.coalesce(out, F.date_format(months, "yyyy-MM"), F.lit(""))


def normalize_date(raw: Column) -> Column:
    """ISO date of a raw one: ISO kept, day first for numeric dates, English and French month
    names anywhere in the text; the trimmed raw text when nothing fits."""
    text = F.trim(raw)
    iso = r"^(\d{4}-\d{2}-\d{2})([T ]\d{2}:\d{2}(:\d{2})?.*)?$"
    day_first = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?!\d)"
    year_first = r"(?<!\d)(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})(?!\d)"
    day_month = rf"(?<!\d)(\d{{1,2}})(?:er|st|nd|rd|th)?\.?\s+{_MONTH}\.?,?\s+(\d{{4}})"
    month_day = rf"{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"

    def at(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        number = _part(text, pattern, month)
        return _date(
            _part(text, pattern, year),
            _month_number(number) if named else number,
            _part(text, pattern, day),
        )

    found = F.coalesce(
        F.try_to_date(_part(text, iso, 1), "yyyy-MM-dd"),
        at(year_first, 1, 2, 3),
        at(day_first, 3, 2, 1),
        at(day_first, 3, 1, 2),
        at(day_month, 3, 2, 1, named=True),
        at(month_day, 3, 1, 2, named=True),
    )
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), text, F.lit(""))
