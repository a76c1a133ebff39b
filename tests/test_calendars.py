"""Calendars against plain walks through their days."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import calendars as C

LENGTHS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def leap(year, calendar):
    if calendar in ("noleap", "all_leap"):
        return calendar == "all_leap"
    gregorian = calendar == "proleptic_gregorian" or calendar == "standard" and year > 1582
    return year % 4 == 0 and (not gregorian or year % 100 != 0 or year % 400 == 0)


def walk(calendar, first, last):
    """All days of the years, in order."""
    for y in range(first, last + 1):
        for m in range(1, 13):
            n = 30 if calendar == "360_day" else LENGTHS[m - 1] + (m == 2 and leap(y, calendar))
            for d in range(1, n + 1):
                if not (calendar == "standard" and (1582, 10, 4) < (y, m, d) < C.REFORM):
                    yield y, m, d


@pytest.mark.parametrize("calendar", ["standard", "proleptic_gregorian", "julian", "noleap", "all_leap", "360_day"])
@pytest.mark.parametrize("years", [(1900, 2100), (1570, 1600), (-5, 9)])
def test_all_days(spark, calendar, years):
    want = list(walk(calendar, *years))
    start = "-".join(map(str, want[0]))
    got = spark.range(len(want)).select("id", C.decoded(F.col("id") * 24 + 6, f"hours since {start} 00:00", calendar).alias("x")).orderBy("id").select("x.*").collect()
    assert [tuple(r[:3]) for r in got] == want and all(r["second"] == 21600 for r in got)
    numbers = [C.day_number(*d, calendar) for d in want]
    assert numbers == list(range(numbers[0], numbers[0] + len(want)))
    there = {d for d in want if 1 <= d[0] and d[2] <= LENGTHS[d[1] - 1] + (d[1] == 2 and leap(d[0], "proleptic_gregorian"))}
    for d, (*_, time) in zip(want, got, strict=True):
        assert (time is None) == (d not in there) and (time is None or time == datetime.datetime(*d, 6))


def test_calendars_meet_at_the_reform():
    assert C.day_number(1582, 10, 15, "gregorian") == C.day_number(1582, 10, 4, "julian") + 1 == C.day_number(1582, 10, 15, "julian") - 10


@pytest.mark.parametrize("units,value,second", [("days since 2000-02-28 12:00:00", 1.5, 0), ("seconds since 2000-02-28", 172800.25, 0.25), ("Minutes since 2000-2-28T23:59", 1441.0, 0), ("h since 2000-03-01 00:00:00.0 UTC", 0, 0)])
def test_units(spark, units, value, second):
    got = spark.range(1).select(C.decoded(F.lit(value), units, "noleap" if "28T" in units else None).alias("x")).select("x.*").first()
    assert (got["year"], got["month"], got["day"], got["second"]) == (2000, 3, 1 + ("28T" in units), second) and got["time"] is not None


def test_a_null_and_an_unknown_name(spark):
    assert spark.range(1).select(C.decoded(F.lit(None).cast("double"), "days since 2000-01-01").alias("x")).select("x.*").first()["time"] is None
    for bad in ("fortnights since 2000-01-01", "days after 2000-01-01"):
        with pytest.raises(ValueError):
            C.parse_units(bad)
    with pytest.raises(ValueError):
        C.calendar_name("lunar")


def test_limits_are_encoded():
    for calendar in ("standard", "noleap", "360_day"):
        at = C.encoded(datetime.datetime(2001, 3, 1, 12), "hours since 2000-03-01 06:00", calendar)
        assert at == {"standard": 365, "noleap": 365, "360_day": 360}[calendar] * 24 + 6
    assert np.isclose(C.encoded(datetime.date(1999, 12, 31), "days since 2000-01-01"), -1)
