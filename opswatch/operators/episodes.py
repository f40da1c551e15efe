"""First detections, anomaly episodes and last valid anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.functions import from_micros, micros
from opswatch.operators.ordered import (
    TARGET_ROWS,
    plan_bounds,
    running_last,
)

SECOND = 1_000_000


def first_detection(
    anomalies: DataFrame,
    injections: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    injected: str = "injected_at",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Each injection with the earliest anomaly at or after it, null without one.

    Both tables walk one time order backwards; anomalies of one time collapse first. No range join.
    """
    seen = (
        anomalies.select(*keys, micros(F.col(ts)).alias("__at"))
        .distinct()
        .withColumn("__detected", F.col("__at"))
        .withColumn("__role", F.lit(1))
    )
    asked = injections.select(
        *keys,
        micros(F.col(injected)).alias("__at"),
        F.lit(None).cast("bigint").alias("__detected"),
        F.lit(0).alias("__role"),
    )
    rows = asked.unionByName(seen)
    bounds = plan_bounds(rows, "__at", target_rows)
    filled = running_last(
        rows, keys, ["__at", "__role"], F.col("__detected"), "__next", bounds, reverse=True
    )
    return filled.where(F.col("__role") == 0).select(
        *keys,
        from_micros(F.col("__at")).alias(injected),
        from_micros(F.col("__next")).alias("detected_at"),
    )


def anomaly_episodes(
    anomalies: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    gap: float = 10.0,
    grace: float = 5.0,
    probe_start: str | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Runs of valid anomalies no more than ``gap`` seconds apart, with their recovery time.

    Anomalies are first reduced to cells of length ``gap`` (members of a cell are always in one
    run), so the ordered part is bounded by the time span and not by the number of anomalies.
    Recovery is ``gap`` after the last anomaly, but not within ``grace`` of the later of the probe
    start and the first anomaly.
    """
    width = round(gap * SECOND)
    at = micros(F.col(ts))
    begun = micros(F.lit(probe_start).cast("timestamp")) if probe_start else F.lit(None)
    cells = (
        anomalies.select(*keys, at.alias("__t"))
        .where(F.col("__t").isNotNull())
        .groupBy(*keys, F.floor(F.col("__t") / F.lit(width)).alias("__cell"))
        .agg(
            F.min("__t").alias("__first"),
            F.max("__t").alias("__last"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    bounds = plan_bounds(cells, "__first", target_rows)
    cells = running_last(
        cells, keys, ["__first"], F.col("__last"), "__prev", bounds, inclusive=False
    )
    opens = F.col("__prev").isNull() | (F.col("__first") - F.col("__prev") > width)
    cells = running_last(
        cells, keys, ["__first"], F.when(opens, F.col("__first")), "__start", bounds
    )
    seen = F.greatest(F.col("__start"), begun.cast("bigint"))
    recovered = F.greatest(F.col("__end") + width, seen + round(grace * SECOND))
    return (
        cells.groupBy(*keys, "__start")
        .agg(F.max("__last").alias("__end"), F.sum("__n").alias("anomalies"))
        .select(
            *keys,
            from_micros(F.col("__start")).alias("first_anomaly"),
            from_micros(F.col("__end")).alias("last_anomaly"),
            "anomalies",
            from_micros(recovered).alias("recovered_at"),
        )
    )


def last_valid(df: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last row, overall or per key, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    last = df.groupBy(*keys).agg(row) if keys else df.agg(row).where(F.col("__row").isNotNull())
    return last.select(*keys, "__row.*")
