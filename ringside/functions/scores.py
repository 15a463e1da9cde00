"""Arithmetic of rates, ratings and outcomes as column expressions."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def safe_percentage(landed: Column, attempted: Column) -> Column:
    """0 to 100; null if nothing was attempted."""
    return F.try_divide(landed, attempted) * 100


def ratio(landed: Column, attempted: Column) -> Column:
    """0 to 1; null unless something was attempted."""
    return F.when(attempted > 0, landed / attempted)


def clip(p: Column, least: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(1.0 - least), p))


def expected_score(a: Column, b: Column, scale: float = 400.0, least: float | None = None) -> Column:
    p = 1.0 / (1.0 + F.pow(F.lit(10.0), (b - a) / scale))
    return p if least is None else clip(p, least)


def decay(days: Column, half_life_years: float) -> Column:
    """What is left of a rating's distance from its start after so many days."""
    return F.pow(F.lit(2.0), -F.greatest(days, F.lit(0)) / (half_life_years * DAYS_PER_YEAR))


def apply_recency(rating: Column, last: Column, now: Column, initial: float, half_life_years: float) -> tuple[Column, Column, Column]:
    """(effective rating, days, factor); without a last date the rating holds, 0 days and 1."""
    days = F.coalesce(F.greatest(F.datediff(now, last), F.lit(0)), F.lit(0))
    factor = F.when(last.isNull(), F.lit(1.0)).otherwise(decay(days, half_life_years))
    return F.when(last.isNull(), rating).otherwise(initial + (rating - initial) * factor), days, factor


def glicko_expected(rating_a: Column, rating_b: Column, rd_b: Column) -> Column:
    """Probability by the opponent's deviation alone, so both sides need not add up to 1."""
    q = log(10) / 400
    g = 1 / F.sqrt(1 + 3 * q * q * rd_b * rd_b / (pi * pi))
    return clip(1 / (1 + F.exp(-g * q * (rating_a - rating_b))), 1e-15)


def win_rate_probability(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.5))


def outcome(result_1: Column, result_2: Column) -> Column:
    """1 for a win of side 1, 0 for a loss, else null."""
    r1, r2 = F.upper(F.trim(result_1)), F.upper(F.trim(result_2))
    return F.when((r1 == "W") & (r2 == "L"), 1).when((r1 == "L") & (r2 == "W"), 0)


def close(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
