"""Calendar, clock and Fourier features as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_features(ts: Column) -> dict[str, Column]:
    """Features of the date. is_quarter_end keeps the month rule ``month % 4 = 3`` that users rely on."""
    month, year = F.month(ts), F.year(ts)
    month_end = F.to_date(ts) == F.last_day(ts)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    first_dow = F.weekday(F.trunc(ts, "month"))
    return {
        "year": year,
        "month": month,
        "day": F.day(ts),
        "dayofweek": F.weekday(ts),
        "dayofyear": F.dayofyear(ts),
        "quarter": F.quarter(ts),
        "season": F.when(month.isin(12, 1, 2), 0).when(month < 6, 1).when(month < 9, 2).otherwise(3),
        "weekofyear": F.weekofyear(ts),
        "weekofmonth": F.ceil((first_dow + F.day(ts)) / 7).cast("int"),
        "is_weekend": F.weekday(ts) >= 5,
        "is_leap_year": leap,
        "is_leap_day": (month == 2) & (F.day(ts) == 29),
        "is_month_end": month_end,
        "is_quarter_end": month_end & (month % 4 == 3),
    }


def time_features(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {
        "hour": hour,
        "minute": F.minute(ts),
        "second": F.second(ts),
        "milliseconds": F.floor(F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) / 1000).cast("int"),
        "quarterhour": (F.floor(F.minute(ts) / 15) + 1).cast("int"),
        "hourofweek": F.weekday(ts) * 24 + hour,
        "daytime": F.when(hour < 6, 0).when(hour < 12, 1).when(hour < 18, 2).otherwise(3),
    }


def datetime_features(ts: Column) -> dict[str, Column]:
    return date_features(ts) | time_features(ts)


def calendar_features(ts: Column) -> dict[str, Column]:
    week_year = F.extract(F.lit("YEAROFWEEK"), ts)
    return {
        "minute": F.minute(ts),
        "hour": F.hour(ts),
        "day": F.day(ts),
        "weekday": F.weekday(ts),
        "dayofyear": F.dayofyear(ts),
        "week": F.concat_ws("-", week_year.cast("string"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "weekofyear": F.weekofyear(ts),
        "minuteofday": F.hour(ts) * 60 + F.minute(ts),
    }


def circle_encode(feature: Column, period: float, modulo: bool = False) -> dict[str, Column]:
    """cos and sin of the feature on a circle of ``period``."""
    x = F.pmod(feature, F.lit(period)) if modulo else feature
    return {"cos": F.cos(x * (2 * math.pi / period)), "sin": F.sin(x * (2 * math.pi / period))}


def fourier_features(ts: Column, periods: list[float], order: int, offset_seconds: float = 1.0) -> dict[str, Column]:
    """sin and cos of 2 pi t j / period, t in units of offset_seconds since 1970."""
    t = F.unix_micros(ts.cast("timestamp")) / F.lit(1e6 * offset_seconds)
    out = {}
    for p in periods:
        for j in range(1, order + 1):
            out[f"fourier_{p:g}_sin_{j}"] = F.sin(t * (2 * math.pi * j / p))
            out[f"fourier_{p:g}_cos_{j}"] = F.cos(t * (2 * math.pi * j / p))
    return out


def one_hot(c: Column, name: str, values: list) -> dict[str, Column]:
    return {f"{name}_is_{v}": (c == F.lit(v)).cast("int") for v in values}


def is_holiday(ts: Column, dates: list[str]) -> Column:
    return F.to_date(ts).isin(*[F.lit(d).cast("date") for d in dates])


def remap(column: Column, values: dict) -> Column:
    """Values exchanged by a mapping; those that it doesn't hold stay."""
    out = column
    for old, new in values.items():
        out = F.when(column == F.lit(old), F.lit(new)).otherwise(out)
    return out


def weekend_masks(ts: Column) -> dict[str, Column]:
    """Whether a time lies on Saturday or Sunday, or on another day: conditions of weekly seasons of their own."""
    weekend = F.weekday(ts) > 4
    return {"weekend_mask": weekend, "workday_mask": ~weekend}


def powers(column: Column, degree: int) -> dict[str, Column]:
    """The column to each whole power from 2 up to ``degree``."""
    return {f"power_{n}": F.pow(column, F.lit(n)) for n in range(2, degree + 1)}
