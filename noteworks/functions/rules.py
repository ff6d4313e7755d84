"""Threshold columns: segments, risk bands, tiers, priority ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_value_segment(clv: Column) -> Column:
    return (
        F.when(clv <= 3000, "Low Value").when(clv <= 7000, "Medium Value").when(clv <= 15000, "High Value")
        .when(clv.isNotNull(), "VIP")
    )


def cut_risk_segment(risk: Column) -> Column:
    return (
        F.when(risk <= 0.3, "Safe").when(risk <= 0.6, "Monitor").when(risk <= 0.8, "At Risk")
        .when(risk.isNotNull(), "Critical")
    )


def cut_risk_level(risk: Column) -> Column:
    """Left-open bands: exactly zero, and anything above one, has no level."""
    return (
        F.when(risk <= 0, F.lit(None)).when(risk <= 0.3, "Low").when(risk <= 0.7, "Medium").when(risk <= 1, "High")
    )


def score_tier(score: Column) -> Column:
    return F.when(score >= 80, "platinum").when(score >= 60, "gold").when(score >= 40, "silver").otherwise("bronze")


def priority_rank(priority: Column) -> Column:
    p = F.lower(priority)
    return F.when(p == "high", 0).when(p == "medium", 1).when(p == "low", 2).otherwise(3)


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, zero when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def half_up(value: Column, digits: int = 1) -> Column:
    """Round a non-negative number half up by floor, so that every engine gets the same last digit."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def mean_tenths(value: Column) -> Column:
    """Mean of one-decimal numbers to one decimal, in whole tenths: free of the order of addition."""
    tenths = F.round(value * 10).cast("bigint")
    return F.call_function("div", 2 * F.sum(tenths) + F.count(value), 2 * F.count(value)) / 10
