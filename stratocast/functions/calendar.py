"""Calendar functions: seasons, days of years and months, date windows and path templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratocast.functions import weather


def season(day: Column, northern: bool = True) -> Column:
    """1 spring to 4 winter."""
    return weather.season(F.month(day), northern).cast("int")


def year_day(day: Column) -> Column:
    return F.dayofyear(day)


def month_days(day: Column) -> Column:
    return F.day(F.last_day(day))


def leap(day: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, with fractions."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600


def same_days_before(day: Column, years: int, days: int) -> Column:
    """All dates within `days` of the same day in each of the last `years` years."""
    middles = [F.add_months(day, -12 * y) for y in range(1, years + 1)]
    return F.flatten(F.array(*[F.sequence(F.date_sub(m, days), F.date_add(m, days)) for m in middles]))


def valid_time(issue: Column, lead_hours: Column) -> Column:
    return issue + F.make_dt_interval(hours=lead_hours)


def path(template: str, issue: Column, lead: Column) -> Column:
    """The template with YYYY, MM, DD and HH of the issue time and VVV, the lead in three digits."""
    out = F.lit(template)
    for mark, pattern in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH")):
        out = F.replace(out, F.lit(mark), F.date_format(issue, pattern))
    return F.replace(out, F.lit("VVV"), F.when(lead < 1000, F.lpad(lead.cast("string"), 3, "0")).otherwise(lead.cast("string")))


def parsed_time(text: Column) -> Column:
    """A time from 4 to 14 digits (year to second), other characters left out; null where it is none."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), n + 1, F.lit(14) - n))
    return F.when(n.isin(4, 6, 8, 10, 12, 14), F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")))
