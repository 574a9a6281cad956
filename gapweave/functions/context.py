"""Temporal, demographic and environmental context of gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    a = F.pmod(value, F.lit(float(period))) * (2 * math.pi / period)
    return F.sin(a), F.cos(a)


def season(month: Column) -> Column:
    """Season of the northern hemisphere."""
    return F.when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").otherwise("autumn")


def diel(hour: Column) -> Column:
    h = F.pmod(hour, F.lit(24.0))
    return F.when((h >= 5) & (h < 8), "dawn").when((h >= 17) & (h < 20), "dusk").when((h >= 8) & (h < 17), "day").otherwise("night")


def clock(t: Column) -> Column:
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


def temporal(start: Column, end: Column) -> dict[str, Column]:
    """Sines and cosines of the hour, month and day of year; diel bin of the midpoint; season."""
    half = (F.timestamp_diff("SECOND", start, end) / 2).cast("long")
    mid = F.timestamp_add("SECOND", half, start)
    out: dict[str, Column] = {}
    for name, value, period in (
        ("start_hour", clock(start), 24.0),
        ("mid_hour", clock(mid), 24.0),
        ("month", F.month(start) - 1.0, 12.0),
        ("dayofyear", F.dayofyear(start) - 1.0, 365.25),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value, period)
    return out | {"diel_bin": diel(clock(mid)), "season": season(F.month(start))}


def cyclic_distance(s1: Column, c1: Column, s2: Column, c2: Column) -> Column:
    return F.sqrt((s1 - s2) * (s1 - s2) + (c1 - c2) * (c1 - c2)) / 2.0
