"""Numeric and conditional expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: Column) -> Column:
    """Text as DOUBLE; whatever is not a number (and NaN) becomes 0.0.

    Java accepts a type suffix (``1d``, ``2.5f``) as part of a number. It is no number here.
    """
    text = F.trim(col.cast("string"))
    suffixed = text.rlike("[0-9.][dDfF]$")
    value = F.when(~suffixed, text.try_cast("double"))
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def anomaly_ratio(mse: Column, threshold: Column) -> Column:
    """Error relative to the threshold, null for a zero threshold."""
    return F.try_divide(mse, threshold)


def tier(ratio: Column) -> Column:
    """normal, low or high anomaly; ``error`` without a ratio.

    NaN compares above every number in Spark, so it is named before the comparisons.
    """
    return (
        F.when(ratio.isNull(), "error")
        .when(F.isnan(ratio), "normal")
        .when(ratio > 2.0, "high_anomaly")
        .when(ratio > 1.0, "low_anomaly")
        .otherwise("normal")
    )


def decide(mse: Column, threshold: Column, factor: float = 1.0) -> Column:
    """1 when the error exceeds ``factor`` thresholds, else 0 (also for NaN or a missing error)."""
    return F.when(~F.isnan(mse) & (mse > threshold * F.lit(float(factor))), 1).otherwise(0)


def first_value_of(*cols: Column) -> Column:
    return F.coalesce(*cols)
