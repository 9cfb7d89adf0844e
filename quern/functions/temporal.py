"""Time values: granularity, literals, truncation, offsets and differences.

Timestamps are wall clock in UTC (TIMESTAMP_NTZ). With a query time zone,
calendar operations happen in that zone and the result is taken back to UTC.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = {"month": 1, "quarter": 3, "year": 12}
DAYS = {"day": 1, "week": 7}
SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def to_zone(c: Column, zone: str | None) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c) if zone and zone != "UTC" else c


def from_zone(c: Column, zone: str | None) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c) if zone and zone != "UTC" else c


def truncate(c: Column, kind: str, unit: str, zone: str | None = None) -> Column:
    """Begin of the unit; weeks begin on Sunday."""
    if kind == "date":
        if unit == "day" or unit in SECONDS:
            return c
        if unit == "week":
            return F.date_sub(c, F.dayofweek(c) - 1)
        return F.trunc(c, unit)
    local = to_zone(c.cast("timestamp_ntz"), None if unit in SECONDS else zone)
    if unit == "week":
        day = local.cast("date")
        out = F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")
    else:
        out = F.date_trunc(unit, local).cast("timestamp_ntz")
    return from_zone(out, None if unit in SECONDS else zone)


def offset(c: Column, kind: str, n: Column, unit: str, zone: str | None = None) -> Column:
    n = n.cast("int")
    if kind == "date":
        if unit in MONTHS:
            return F.add_months(c, n * MONTHS[unit])
        if unit in DAYS:
            return F.date_add(c, n * DAYS[unit])
        c, kind = c.cast("timestamp_ntz"), "timestamp"
    if unit in MONTHS:
        step = F.make_ym_interval(F.lit(0), n * MONTHS[unit])
    elif unit in DAYS:
        step = F.make_dt_interval(n * DAYS[unit], F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    else:
        zone = None
        step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * SECONDS[unit]).cast("decimal(18,6)"))
    return from_zone(to_zone(c, zone) + step, zone)


def extract(c: Column, unit: str, zone: str | None, kind: str) -> Column:
    local = to_zone(c, zone) if kind != "date" else c
    fn = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour,
        "minute": F.minute, "day_of_week": F.dayofweek, "day_of_year": F.dayofyear,
    }
    if unit == "second":
        return F.second(local).cast("int")
    return fn[unit](local)


def difference(a: Column, b: Column, unit: str) -> Column:
    """Complete units from a to b, negative if b is before a."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    if unit in MONTHS:
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        # A month is complete once the same day and time are reached again, or
        # the last day of a shorter month.
        fits = lambda x, y: (F.dayofmonth(y) > F.dayofmonth(x)) | ((F.dayofmonth(y) == F.dayofmonth(x)) & ((y - F.date_trunc("day", y).cast("timestamp_ntz")) >= (x - F.date_trunc("day", x).cast("timestamp_ntz")))) | ((y.cast("date") == F.last_day(y)) & (F.dayofmonth(x) > F.dayofmonth(y)))
        months = months - F.when(b >= a, F.when(fits(a, b), 0).otherwise(1)).otherwise(F.when(fits(b, a), 0).otherwise(-1))
        return F.expr("0").cast("bigint") + toward_zero(months / MONTHS[unit])
    seconds = SECONDS.get(unit) or DAYS[unit] * 86400
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return toward_zero(micros / (seconds * 1_000_000))


def toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


_LITERAL = re.compile(r"(\d{4})(?:-(?:Q([1-4])|(\d\d)(?:-(\d\d)(?:-(WK)|[T ](\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?)?)?))?(?:\[([^\]]+)\])?$")


def literal(text: str, zone: str | None = None) -> tuple[Column, str, str | None, Column]:
    """(begin, kind, unit, end) of a time literal without its @."""
    m = _LITERAL.match(text)
    if not m:
        raise ValueError(f"bad time literal @{text}")
    y, q, mo, d, wk, h, mi, s, frac, own = m.groups()
    zone = own or zone
    begin = datetime(int(y), (int(q) - 1) * 3 + 1 if q else int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0")[:6].ljust(6, "0")))
    unit = "quarter" if q else "week" if wk else None if frac else "second" if s else "minute" if mi else "hour" if h else "day" if d else "month" if mo else "year"
    if wk and begin.isoweekday() != 7:
        raise ValueError(f"@{text}: weeks begin on Sunday")
    kind = "timestamp" if h else "date"
    end = _next(begin, unit)
    if kind == "date":
        return F.lit(begin.date()), kind, unit, F.lit(end.date())
    if zone and zone != "UTC":
        begin, end = (x.replace(tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for x in (begin, end))
    return F.lit(begin).cast("timestamp_ntz"), kind, unit, F.lit(end).cast("timestamp_ntz")


def _next(begin: datetime, unit: str | None) -> datetime:
    if unit is None:
        return begin
    if unit in MONTHS:
        n = begin.year * 12 + begin.month - 1 + MONTHS[unit]
        return begin.replace(year=n // 12, month=n % 12 + 1)
    return begin + timedelta(days=DAYS.get(unit, 0), seconds=SECONDS.get(unit, 0))


def is_date(x: object) -> bool:
    return isinstance(x, date) and not isinstance(x, datetime)
