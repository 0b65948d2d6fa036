"""Scalar arithmetic of masking, budgets, schedules and display."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_predictions(share: float, length: int) -> int:
    return max(1, round(share * length))


def mask_count(maskable: Column, share: float, most: int) -> Column:
    """How many of a row's ids are masked: none if none may be."""
    wanted = F.least(F.greatest(F.rint(maskable * F.lit(share)).cast("int"), F.lit(1)), maskable, F.lit(most))
    return F.when(maskable > 0, wanted).otherwise(0)


def estimated_tokens(length: Column, chars_per_token: float = 3.0) -> Column:
    return F.greatest(F.lit(1), F.floor(length / F.lit(chars_per_token)).cast("int") + 1)


def backoff_seconds(attempt: Column, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2.0), attempt))


def clamped_budget(budget: Column, cost: Column, floor: int) -> Column:
    return F.greatest(F.least(budget, F.floor(cost / 2).cast("long")), F.lit(floor))


def padded_length(n: Column, multiple: int = 8) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def trapezoid(step: Column, total: int, peak: float, warmup: float = 0.03, decay: float = 0.15) -> Column:
    """Linear rise, level, then peak * (1 - sqrt of the share of the decay that has passed)."""
    up, down = max(1, int(warmup * total)), max(1, int(decay * total))
    level = max(1, total - up - down)
    fall = F.lit(peak) * (1 - F.sqrt(F.least((step - (up + level)) / F.lit(float(down)), F.lit(1.0))))
    return F.when(step < up, F.lit(peak) * step / up).when(step < up + level, F.lit(peak)).otherwise(fall)


def warmup_cosine(step: Column, total: int, peak: float, warmup: int, end_share: float = 0.1) -> Column:
    total = max(2, total)
    up = min(warmup, max(1, total // 2))
    passed = F.least((step - up) / F.lit(float(max(1, total - up))), F.lit(1.0))
    cosine = F.lit(peak) * (F.lit(end_share) + (1 - end_share) * 0.5 * (1 + F.cos(F.lit(math.pi) * passed)))
    return F.when(step < up, F.lit(peak) * step / up).otherwise(cosine)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def mlp_width(hidden: Column) -> Column:
    return (F.bround(hidden * F.lit(8.0) / 3 / 64) * 64).cast("int")


def clock(seconds: Column) -> Column:
    """h:mm:ss"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def short_clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; nothing under 0."""
    whole = F.greatest(F.floor(seconds).cast("long"), F.lit(0))
    return F.when(whole >= 3600, clock(whole)).otherwise(F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))
