"""Column functions on numbers, flags, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bool(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "yes", "y", "on"), True).when(v.isin("0", "false", "no", "n", "off"), False)


def positive_int(c: Column) -> Column:
    v = F.trim(c).try_cast("int")
    return F.when(v > 0, v)


def number_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def unit(c: Column, places: int = 4) -> Column:
    """Clamped to [0, 1] and rounded; null as 0."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))), places)


def coerce_score(c: Column) -> Column:
    """Rounded half to even, kept from 1 to 5."""
    v = F.bround(c).cast("int")
    return F.when(v.between(1, 5), v)


def strict_date(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(F.trim(c), "yyyy-MM-dd"))


def age(birth: Column, today: Column) -> Column:
    """Whole years by month and day; negative as null."""
    years = F.year(today) - F.year(birth) - F.when(F.date_format(today, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)
    return F.when(years >= 0, years)


def seniority(years: Column) -> Column:
    return F.when(years.isNull(), None).when(years < 2, "junior").when(years < 5, "mid").when(years < 10, "senior").when(years < 15, "lead").otherwise("principal")


def years_of(periods: Column, today: Column) -> Column:
    """Sum of the periods' years (struct start_date, end_date of dates), an open end as today; 0 as null."""
    days = lambda p: F.greatest(F.lit(0), F.datediff(F.coalesce(p.end_date, today), p.start_date))
    total = F.aggregate(F.filter(periods, lambda p: p.start_date.isNotNull()), F.lit(0.0), lambda a, p: a + days(p) / 365.25)
    return F.nullif(F.round(total, 1), F.lit(0.0))


def recency_boost(moment: Column, now: Column, boost: float = 0.02, days: int = 180) -> Column:
    """The boost for moments no older than so many days, later ones included."""
    old = F.floor((F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400)
    return F.when(old <= days, boost).otherwise(0.0)


def backoff(attempt: Column, base: float = 0.75, most: float = 8.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def saturation(c: Column) -> Column:
    return F.when(c > 0, c / (1 + c)).otherwise(0.0)


def availability_score(days: Column) -> Column:
    return F.when(days.isNull(), 0.0).when(days <= 30, 1.0).when(days <= 60, 0.6).otherwise(0.2)


def salvage_json(c: Column) -> Column:
    """The text itself if it is a JSON object, else what stands between its first and last brace if that is one."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")
    return F.when(valid(c), F.trim(c)).when(valid(inner), inner)
