"""Temporal cues of questions as closed intervals, in one expression; dates of sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue patterns, in the order in which they are asked.
CHANGE = "(?i)\\b(how many times|how often|each time|every time|all the|history of|changed|changes|over time|so far|in total|different)\\b"
DATE = "\\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\\b"
AGO = "(?i)([0-9]+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)\\s+(day|week|month|year)s?\\s+ago"
LAST_UNIT = "(?i)\\b(last|past|previous)\\s+(week|month|year)\\b"
MONTH = "(?i)\\b(september|february|november|december|january|october|august|march|april|june|july|may|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\\b\\.?\\s*([0-9]{4})?"
NOW = "(?i)\\b(now|currently|current|these days|at the moment|today|nowadays|present)\\b"
BEFORE = "(?i)\\b(last time|previously|before that|the previous|used to|earlier|originally|at first|initially)\\b"
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _ntz(x: Column) -> Column:
    return x.cast("timestamp_ntz")


def _day_end(day: Column) -> Column:
    return _ntz(day) + F.expr("interval 86399 seconds")


def month_interval(day: Column) -> tuple[Column, Column]:
    return _ntz(F.trunc(day, "month")), _day_end(F.last_day(day))


def year_interval(year: Column) -> tuple[Column, Column]:
    return _ntz(F.make_date(year, F.lit(1), F.lit(1))), _day_end(F.make_date(year, F.lit(12), F.lit(31)))


def _days(now: Column, n: Column) -> Column:
    return now - F.make_dt_interval(n)


def parse_temporal(question: Column, now: Column) -> Column:
    """(mode, start, end): none, now, interval, before_latest or whole_chain; end inclusive. now: timestamp_ntz.

    Days ago mean that moment a day either way, weeks ago three days either way. A month without a year is the
    last one at or before now; a name of up to three letters must be capitalised.
    """
    q = F.btrim(question)

    def struct(mode: str, start: Column | None = None, end: Column | None = None) -> Column:
        none = F.lit(None).cast("timestamp_ntz")
        return F.struct(F.lit(mode).alias("mode"), (none if start is None else start).alias("start"), (none if end is None else end).alias("end"))

    said = F.lower(F.regexp_extract(q, AGO, 1))
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), said), said.try_cast("int"))
    unit = F.lower(F.regexp_extract(q, AGO, 2))
    today = now.cast("date")
    back = F.add_months(today, -n)
    ago = (
        F.when(unit == "day", struct("interval", _days(now, n + 1), _days(now, n - 1)))
        .when(unit == "week", struct("interval", _days(now, n * 7 + 3), _days(now, n * 7 - 3)))
        .when(unit == "month", struct("interval", *month_interval(back)))
        .otherwise(struct("interval", *year_interval(F.year(today) - n)))
    )
    last = F.lower(F.regexp_extract(q, LAST_UNIT, 2))
    last_unit = (
        F.when(last == "week", struct("interval", _days(now, F.lit(14)), now))
        .when(last == "month", struct("interval", *month_interval(F.add_months(today, -1))))
        .otherwise(struct("interval", *year_interval(F.year(today) - 1)))
    )
    name, said_year = F.regexp_extract(q, MONTH, 1), F.regexp_extract(q, MONTH, 2)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")
    year = F.coalesce(said_year.try_cast("int"), F.when(number <= F.month(today), F.year(today)).otherwise(F.year(today) - 1))
    day = F.make_date(year, F.greatest(number, F.lit(1)), F.lit(1))
    date = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(q, DATE, k) for k in (1, 2, 3)]), "y-M-d")
    return (
        F.when(q.rlike(CHANGE), struct("whole_chain"))
        .when(date.isNotNull(), struct("interval", _ntz(date), _day_end(date)))
        .when(q.rlike(AGO), ago)
        .when(q.rlike(LAST_UNIT), last_unit)
        .when((name != "") & ((F.length(name) > 3) | name.rlike("^[A-Z][a-z]*$")), struct("interval", *month_interval(day)))
        .when(q.rlike(NOW), struct("now", now, now))
        .when(q.rlike(BEFORE), struct("before_latest"))
        .otherwise(struct("none"))
    )


def parse_session_date(text: Column) -> Column:
    """timestamp_ntz of the formats a session's date comes in; null for others."""
    bare = F.regexp_replace(F.btrim(text), "\\s*\\([A-Za-z]{3}\\)", "")
    kinds = ("yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(k)).cast("timestamp_ntz") for k in kinds])


def relative_date(text: Column, at: Column) -> Column:
    """Days and units ago, yesterday, and last or next weekdays, as dates relative to a session; null for others."""
    t, day = F.lower(F.btrim(text)), at.cast("date")
    said = F.regexp_extract(t, AGO, 1)
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), said), said.try_cast("int"))
    unit = F.regexp_extract(t, AGO, 2)
    which, weekday = (F.regexp_extract(t, "^(last|past|this|next|coming)\\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\b", k) for k in (1, 2))
    out = F.lit(None).cast("date")
    for name in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"):
        out = F.when(weekday == name, F.when(which.isin("next", "coming"), F.next_day(day, name[:3])).otherwise(F.next_day(F.date_sub(day, 8), name[:3]))).otherwise(out)
    return (
        F.when(t == "yesterday", F.date_sub(day, 1)).when(t == "today", day).when(t == "tomorrow", F.date_add(day, 1))
        .when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, n * 7)).when(unit == "month", F.add_months(day, -n)).when(unit == "year", F.add_months(day, n * -12))
        .otherwise(out)
    )


def intersects(start: Column, end: Column, valid_from: Column, valid_to: Column) -> Column:
    """Does the closed [start, end] meet the half-open [valid_from, valid_to)?"""
    return (end >= valid_from) & (valid_to.isNull() | (start < valid_to))


def valid_at(at: Column, valid_from: Column, valid_to: Column) -> Column:
    return (at >= valid_from) & (valid_to.isNull() | (at < valid_to))
