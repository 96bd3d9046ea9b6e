"""Dates, periods and intervals as column expressions (O-DT01..08).  A reference date is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso(year: Column, month: Column, day: Column) -> Column:
    """O-DT01: midnight of a day in ISO form, formatted as given even if there is no such day."""
    return F.format_string("%04d-%02d-%02dT00:00:00", year, month, day)


def parse_iso(c: Column) -> Column:
    """Timestamp of an ISO date or time, null if it is none."""
    return F.when(F.length(c) == 10, F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(c, F.lit(_ISO)))


def end_of_period(start: Column, granularity: Column) -> Column:
    """O-DT02: the last second of the period of ``start``; other granularities: ``start``.

    A day and a year end at 23:59:59; a week seven days, a month and a quarter with the next one's first day, less a
    second, at the time of day that ``start`` has.
    """
    second, day = F.expr("interval 1 second"), F.date_trunc("day", start)
    clock = start - day
    first_of = lambda unit, n: F.timestamp_add("MONTH", F.lit(n), F.date_trunc(unit, start)) + clock - second
    return (
        F.when(granularity == "DAY", F.timestamp_add("DAY", F.lit(1), day) - second)
        .when(granularity == "WEEK", F.timestamp_add("DAY", F.lit(7), start) - second)
        .when(granularity == "MONTH", first_of("month", 1))
        .when(granularity == "QUARTER", first_of("quarter", 3))
        .when(granularity == "YEAR", F.timestamp_add("MONTH", F.lit(12), F.date_trunc("year", start)) - second)
        .otherwise(start)
    )


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """O-DT03: closed intervals of ISO strings meet; false if one can't be read."""
    a, b, c, d = (parse_iso(x) for x in (a_start, a_end, b_start, b_end))
    return F.coalesce(~((b < c) | (d < a)), F.lit(False))


def is_before(a_end: Column, b_start: Column) -> Column:
    """O-DT04."""
    return F.coalesce(parse_iso(a_end) < parse_iso(b_start), F.lit(False))


def quarter_start(numeral: Column) -> Column:
    """O-DT05: first month of a quarter in Roman or Arabic digits, 1 for anything else."""
    low = F.lower(numeral)
    return F.when(low.isin("ii", "2"), 4).when(low.isin("iii", "3"), 7).when(low.isin("iv", "4"), 10).otherwise(1)


def date_verdict(claimed: Column, known: Column) -> Column:
    """O-DT06: struct(status, confidence) by the days between two ISO dates; unreadable: UNVERIFIED, 0.3."""
    days = F.abs(F.datediff(parse_iso(claimed), parse_iso(known)))
    pair = lambda s, c: F.struct(F.lit(s).alias("status"), c.cast("double").alias("confidence"))
    return (
        F.when(days <= 7, pair("VERIFIED", F.greatest(F.lit(0.5), 1 - days / 30)))
        .when(days <= 30, pair("PARTIALLY_VERIFIED", F.lit(0.5)))
        .when(days.isNotNull(), pair("CONTRADICTED", F.lit(0.2)))
        .otherwise(pair("UNVERIFIED", F.lit(0.3)))
    )


def simulated_date(reference: str, key: Column) -> Column:
    """O-DT08: the reference date less 0 to 10 days, fixed by the key."""
    return F.date_format(F.date_sub(F.lit(reference).cast("date"), F.pmod(key, F.lit(11)).cast("int")), "yyyy-MM-dd")
