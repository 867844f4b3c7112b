"""Time scalars: civil dates, periods, freshness, and phrases that name a period."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def parse_timestamp(text: Column) -> Column:
    """Epoch seconds of a date or date-time with optional offset; null if it is none."""
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]))


def day_of(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def period_bounds(seconds: Column, period: str) -> tuple[Column, Column]:
    """First and last second of the day, week (from Monday), month or year."""
    start = F.date_trunc(period, F.timestamp_seconds(seconds))
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[period]
    return F.unix_timestamp(start), F.unix_timestamp(start + F.expr(step)) - 1


def freshness(valid_until: Column, source_uri: Column, now: int) -> Column:
    return F.when(valid_until.isNotNull(), F.when(valid_until < now, "stale").otherwise("current")).when(source_uri.isNotNull(), "current").otherwise("unknown")


# Names of months and units in English and German.
MONTHS = {name.lower(): n for n, names in enumerate([("January", "Januar"), ("February", "Februar"), ("March", "März"), ("April",), ("May", "Mai"), ("June", "Juni"), ("July", "Juli"), ("August",), ("September",), ("October", "Oktober"), ("November",), ("December", "Dezember")], 1) for name in names}
UNITS = {"day": 1, "days": 1, "tag": 1, "tage": 1, "tagen": 1, "week": 7, "weeks": 7, "woche": 7, "wochen": 7, "month": 30, "months": 30, "monat": 30, "monate": 30, "monaten": 30, "year": 365, "years": 365, "jahr": 365, "jahre": 365, "jahren": 365}


def _seconds(day: dt.date) -> int:
    return calendar.timegm(day.timetuple())


def _span(first: dt.date, last: dt.date) -> tuple[int, int]:
    return _seconds(first), _seconds(last) + DAY - 1


def _month(year: int, month: int) -> tuple[int, int]:
    return _span(dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1]))


def parse_period(query: str, now: int) -> tuple[int, int] | None:
    """First and last second of the period that a query names, or None.

    Looks for, in this order: a date; yesterday, today, tomorrow; so many units
    ago or ahead (a month counts 30 days, a year 365); a week or month; a year; a
    quarter; the name of a month, with or without a year.
    """
    low, today = query.lower(), dt.datetime.fromtimestamp(now, dt.UTC).date()
    if m := re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", low):
        try:
            day = dt.date(*map(int, m.groups()))
            return _span(day, day)
        except ValueError:
            pass
    for words, shift in ((("yesterday", "gestern"), -1), (("today", "heute"), 0), (("tomorrow", "morgen"), 1)):
        if any(re.search(rf"\b{w}\b", low) for w in words):
            day = today + dt.timedelta(shift)
            return _span(day, day)
    unit = "|".join(UNITS)
    for form, sign in ((rf"\b(\d+) ({unit}) ago\b", -1), (rf"\bvor (\d+) ({unit})\b", -1), (rf"\bin (\d+) ({unit})\b", 1)):
        if m := re.search(form, low):
            day = today + dt.timedelta(sign * int(m[1]) * UNITS[m[2]])
            return _span(day, day)
    monday = today - dt.timedelta(today.weekday())
    for words, shift in ((("last week", "letzte woche", "letzten woche"), -1), (("this week", "diese woche", "dieser woche"), 0), (("next week", "nächste woche", "nächsten woche"), 1)):
        if any(w in low for w in words):
            first = monday + dt.timedelta(7 * shift)
            return _span(first, first + dt.timedelta(6))
    for words, shift in ((("last month", "letzten monat", "letzter monat"), -1), (("this month", "diesen monat", "diesem monat"), 0), (("next month", "nächsten monat"), 1)):
        if any(w in low for w in words):
            n = today.year * 12 + today.month - 1 + shift
            return _month(n // 12, n % 12 + 1)
    for words, shift in ((("last year", "letztes jahr", "letzten jahr"), -1), (("this year", "dieses jahr", "diesem jahr"), 0), (("next year", "nächstes jahr"), 1)):
        if any(w in low for w in words):
            return _span(dt.date(today.year + shift, 1, 1), dt.date(today.year + shift, 12, 31))
    if m := re.search(r"\bq([1-4])(?:\s+(\d{4}))?\b", low):
        year, quarter = int(m[2] or today.year), int(m[1])
        return _month(year, 3 * quarter - 2)[0], _month(year, 3 * quarter)[1]
    for name, number in MONTHS.items():
        if m := re.search(rf"\b{name}\b(?:\s+(\d{{4}}))?", low):
            return _month(int(m[1] or today.year), number)
    if m := re.search(r"\b(19|20)(\d{2})\b", low):
        year = int(m[0])
        return _span(dt.date(year, 1, 1), dt.date(year, 12, 31))
    return None


def parse_relative(phrase: str, now: int) -> tuple[int, int] | None:
    """The second reading of phrases: windows that end now, an hour around other moments."""
    low = phrase.lower()
    if "last week" in low or "letzte woche" in low:
        return now - 6 * DAY, now
    if "last month" in low or "letzten monat" in low:
        return now - 30 * DAY, now
    if found := parse_period(phrase, now):
        middle = (found[0] + found[1] + 1) // 2
        return middle - 3600, middle + 3600
    return None
