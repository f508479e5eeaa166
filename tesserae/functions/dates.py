"""Minute codes and epoch minutes."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX32 = 2**31 - 1


def _checked(minutes: int, value) -> int:
    if minutes > MAX32 or minutes < -MAX32:
        raise OverflowError(f"{value!r} is outside the range of dates that can be indexed")
    return minutes


def as_datetime(value, local: dt.tzinfo | None = None) -> dt.datetime | None:
    """A date value in UTC; None if it isn't one. Numbers are seconds since 1970, strings ISO dates."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return dt.datetime.fromtimestamp(value, dt.UTC)
    if isinstance(value, str) and value:
        value = dt.datetime.fromisoformat(value)
        local = None
    if isinstance(value, dt.datetime):
        zone = value.tzinfo or local or dt.UTC
        return value.replace(tzinfo=zone).astimezone(dt.UTC)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day, tzinfo=dt.UTC)
    return None


def minute_code(value, precision: int = 1, local: dt.tzinfo | None = None) -> int | None:
    """A date as one number that orders like it: months of 31 days, floored to ``precision`` minutes."""
    t = as_datetime(value, local)
    if t is None:
        return None
    code = (((t.year * 12 + t.month) * 31 + t.day) * 24 + t.hour) * 60 + t.minute
    return _checked(code - code % max(1, precision), value)


def minute_code_column(value: Column, kind: str, precision: int = 1, local: str | None = None) -> Column:
    """The same for a column of Spark type ``kind``; a code beyond 32 bits raises an error."""
    if kind in ("timestamp", "date", "timestamp_ntz"):
        stamp = value
        if kind == "timestamp_ntz" and local:
            stamp = F.convert_timezone(F.lit(local), F.lit("UTC"), value)
        elif kind == "timestamp":
            stamp = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
    elif kind == "string":
        stamp = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp(F.nullif(value, F.lit(""))).cast("timestamp_ntz"))
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        seconds = F.floor(value.cast("double")).cast("bigint")
        stamp = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    else:
        return F.lit(None).cast("int")
    day = (F.year(stamp) * 12 + F.month(stamp)) * 31 + F.dayofmonth(stamp)
    minutes = F.lit(0) if kind == "date" else F.hour(stamp) * 60 + F.minute(stamp)
    code = day.cast("bigint") * 1440 + minutes
    if precision > 1:
        code = code - F.pmod(code, F.lit(precision))
    return code.cast("int")


def epoch_minutes(value, precision: int = 1) -> int | None:
    """Minutes since 1970, numbers being minutes already; floored to ``precision``, then cut toward 0."""
    if value is None:
        return None
    if not isinstance(value, (int, float)):
        t = as_datetime(value)
        if t is None:
            raise TypeError(f"{value!r} isn't a date")
        value = (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(minutes=1)
    if precision > 1:
        value -= value % precision
    return _checked(math.trunc(value), value)


def epoch_minutes_column(value: Column, kind: str, precision: int = 1, floor: int | None = None, ceiling: int | None = None) -> Column:
    """The same for a column; values outside [floor, ceiling] leave the side open (null)."""
    if kind in ("timestamp", "date"):
        minutes = F.unix_micros(value.cast("timestamp")) / F.lit(60e6)
    elif kind == "timestamp_ntz":
        minutes = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), value).cast("timestamp")) / F.lit(60e6)
    elif kind == "string":
        minutes = F.unix_micros(F.to_timestamp(F.nullif(value, F.lit("")))) / F.lit(60e6)
    else:
        minutes = value
    if precision > 1:
        minutes = F.floor(minutes / precision) * precision
    minutes = minutes.cast("bigint")
    open_ = minutes.isNull()
    if floor is not None:
        open_ = open_ | (minutes < floor)
    if ceiling is not None:
        open_ = open_ | (minutes > ceiling)
    beyond = F.raise_error(F.concat(F.lit("not within the range of dates: "), minutes.cast("string"))).cast("bigint")
    return F.when(open_, F.lit(None).cast("bigint")).when(F.abs(minutes) > MAX32, beyond).otherwise(minutes)
