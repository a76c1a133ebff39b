"""Dates of the calendars that climate data come in, as column expressions.

A day number counts from the calendar's own 1 January of year 0 (where it has one);
dates and day numbers turn into each other by integer arithmetic, so that no date has
to exist in Spark's own calendar.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that calendars go by.
NAMES = {
    "standard": "standard", "gregorian": "standard", "proleptic_gregorian": "proleptic_gregorian", "julian": "julian",
    "noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day",
}
SECONDS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400}
#: Days of a period of leap years, counted from 1 March, and its years.
PERIODS = {"julian": (1461, 4), "proleptic_gregorian": (146097, 400)}
#: The day of the standard calendar from which on it is the Gregorian one, and the
#: Julian calendar's lead in days, counted as below.
REFORM, LEAD = (1582, 10, 15), 2


def calendar_name(name: str | None) -> str:
    found = NAMES.get((name or "standard").lower())
    if found is None:
        raise ValueError(f"no calendar {name}")
    return found


def _div(a: Column, b: int) -> Column:
    """Whole part, rounded down, of longs; exact at any size."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def day_number(year: int, month: int, day: int, calendar: str) -> int:
    """Days from the calendar's 1 March of year 0 (julian and Gregorian), or 1 January of
    year 0; the Gregorian count is on the Julian one's scale."""
    calendar = calendar_name(calendar)
    if calendar == "standard":
        calendar = "proleptic_gregorian" if (year, month, day) >= REFORM else "julian"
    if calendar == "360_day":
        return 360 * year + 30 * (month - 1) + day - 1
    y, m = (year, month - 3) if month > 2 else (year - 1, month + 9)
    doy = (153 * m + 2) // 5 + day - 1
    if calendar == "julian":
        return 1461 * y // 4 + doy
    if calendar == "proleptic_gregorian":
        return 365 * y + y // 4 - y // 100 + y // 400 + doy + LEAD
    # Years of one length: a leap day would come at the end of a year from 1 March.
    return (365 if calendar == "noleap" else 366) * y + doy


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body has it."""
    return F.transform(F.array(value), body)[0]


def _from_march(z: Column, period: int, years: int) -> Column:
    """Year, month and day of days from 1 March of year 0."""
    def within(day: Column) -> Column:
        if years == 4:
            of_era = F.least(_div(day, 365), F.lit(3))
            start = lambda y: y * 365
        else:
            of_era = _div(day - _div(day, 1460) + _div(day, 36524) - _div(day, 146096), 365)
            start = lambda y: y * 365 + _div(y, 4) - _div(y, 100)
        return _let(of_era, lambda y: _month_and_day(_div(z, period) * years + y, day - start(y)))

    return _let(F.pmod(z, F.lit(period)), within)


def _month_and_day(year: Column, doy: Column) -> Column:
    def made(x: Column) -> Column:
        y, m, day = (x.getField(k) for k in ("y", "m", "day"))
        month = (F.pmod(m + 2, F.lit(12)) + 1).cast("int")
        return F.struct((y + (m >= 10).cast("long")).cast("int").alias("year"), month.alias("month"), (day - _div(m * 153 + 2, 5) + 1).cast("int").alias("day"))

    return _let(F.struct(year.alias("y"), doy.alias("day")), lambda x: _let(F.struct(x.getField("y").alias("y"), _div(x.getField("day") * 5 + 2, 153).alias("m"), x.getField("day").alias("day")), made))


def date_parts(number: Column, calendar: str) -> Column:
    """Struct of year, month and day from a day number as day_number() counts."""
    calendar = calendar_name(calendar)

    def parts(z: Column) -> Column:
        if calendar == "360_day":
            return F.struct(_div(z, 360).cast("int").alias("year"), (F.pmod(_div(z, 30), F.lit(12)) + 1).cast("int").alias("month"), (F.pmod(z, F.lit(30)) + 1).cast("int").alias("day"))
        if calendar in ("noleap", "all_leap"):
            size = 365 if calendar == "noleap" else 366
            return _month_and_day(_div(z, size), F.pmod(z, F.lit(size)))
        julian, gregorian = _from_march(z, *PERIODS["julian"]), _from_march(z - LEAD, *PERIODS["proleptic_gregorian"])
        if calendar == "standard":
            return F.when(z >= day_number(*REFORM, "proleptic_gregorian"), gregorian).otherwise(julian)
        return julian if calendar == "julian" else gregorian

    return _let(number.cast("long"), parts)


def parse_units(units: str) -> tuple[int, tuple[int, int, int], int]:
    """Seconds of a unit, the date it counts from, and the seconds of that day, from
    text such as ``hours since 1850-01-01 06:00:00``."""
    found = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T\s]+(\d+):(\d+)(?::(\d+)(?:\.\d*)?)?)?\s*(?:Z|UTC)?\s*", units, re.IGNORECASE)
    unit = SECONDS.get(found[1].lower()) if found else None
    if unit is None:
        raise ValueError(f"not a unit of time: {units}")
    hours, minutes, seconds = (int(found[k] or 0) for k in (5, 6, 7))
    return unit, (int(found[2]), int(found[3]), int(found[4])), hours * 3600 + minutes * 60 + seconds


def decoded(value: Column, units: str, calendar: str | None = None) -> Column:
    """Struct of year, month, day, second (of the day, to the microsecond) and time: a
    timestamp without zone, null where Spark's calendar has no such date."""
    unit, date, start = parse_units(units)
    day_size, first = 86_400_000_000, day_number(*date, calendar)

    def made(x: Column) -> Column:
        year, month, day, rest = (*(x.getField("date").getField(k) for k in ("year", "month", "day")), x.getField("rest"))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        second = (F.pmod(rest, F.lit(60_000_000)) / 1e6).cast("decimal(16,6)")
        time = F.make_timestamp_ntz(year, month, day, _div(rest, 3_600_000_000).cast("int"), F.pmod(_div(rest, 60_000_000), F.lit(60)).cast("int"), second)
        return F.struct(year.alias("year"), month.alias("month"), day.alias("day"), (rest / 1e6).alias("second"), F.when((day <= last) & year.between(1, 9999), time).alias("time"))

    micro = F.round(value.cast("double") * unit * 1_000_000).cast("long") + start * 1_000_000
    split = lambda m: F.struct(date_parts(_div(m, day_size) + first, calendar).alias("date"), F.pmod(m, F.lit(day_size)).alias("rest"))
    return _let(_let(micro, split), made)


def encoded(when: datetime.datetime | datetime.date, units: str, calendar: str | None = None) -> float:
    """What a date is in the units, for limits that are pushed into a read."""
    unit, date, start = parse_units(units)
    days = day_number(when.year, when.month, when.day, calendar) - day_number(*date, calendar)
    seconds = when.hour * 3600 + when.minute * 60 + when.second if isinstance(when, datetime.datetime) else 0
    return (days * 86400 + seconds - start) / unit
