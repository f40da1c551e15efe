"""Counter and gauge conditions, alert states and alert recovery on tables of samples.

Times inside are epoch microseconds; every operator takes any TIMESTAMP column and keeps it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions import from_micros, micros
from opswatch.operators.ordered import (
    TARGET_ROWS,
    island_starts,
    plan_bounds,
    running_last,
    running_sum,
)

SECOND = 1_000_000
_AT = "__at"


def _seconds(value: float) -> int:
    return round(value * SECOND)


def _cumulative(
    samples: DataFrame, series: Sequence[str], ts: str, value: str, target_rows: int
) -> tuple[DataFrame, tuple[float, ...]]:
    """One row per (series, time) with the running sum of reset-adjusted deltas.

    Copies of a sample collapse first, so times are unique within a series.
    """
    unique = samples.groupBy(*series, micros(F.col(ts)).alias(_AT)).agg(
        F.max(F.col(value).cast("double")).alias("__v")
    )
    bounds = plan_bounds(samples.select(micros(F.col(ts)).alias(_AT)), _AT, target_rows)
    rows = running_last(unique, series, [_AT], F.col("__v"), "__prev", bounds, inclusive=False)
    delta = (
        F.when(F.col("__prev").isNull(), 0.0)
        .when(F.col("__v") < F.col("__prev"), F.col("__v"))
        .otherwise(F.col("__v") - F.col("__prev"))
    )
    rows = running_sum(rows, series, [_AT], delta, "__cum", bounds)
    return rows.select(*series, _AT, "__v", "__cum"), bounds


def counter_increase(
    samples: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    window: float = 30.0,
    out: str = "increase",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Growth of a counter over the ``window`` seconds up to each of its samples.

    The range is left-open; a drop is a restart from zero; a delta counts when both its samples are
    in the range. The first sample inside the range is found by walking samples and range starts in
    one order, so no row meets more than its neighbour. One row per (series, time).
    """
    rows, bounds = _cumulative(samples, series, ts, value, target_rows)
    span = _seconds(window)
    # Samples sort before range starts at the same time: a sample on the start is outside.
    events = rows.select(
        *series,
        F.explode(
            F.array(
                F.struct(
                    F.col(_AT).alias("pos"), F.lit(0).alias("role"), F.col("__cum").alias("first")
                ),
                F.struct(
                    (F.col(_AT) - span).alias("pos"),
                    F.lit(1).alias("role"),
                    F.lit(None).cast("double").alias("first"),
                ),
            )
        ).alias("__e"),
        _AT,
        "__v",
        "__cum",
    ).select(*series, "__e.*", _AT, "__v", "__cum")
    filled = running_last(
        events, series, ["pos", "role"], F.col("first"), "__first", bounds, reverse=True
    )
    return filled.where(F.col("role") == 1).select(
        *series,
        from_micros(F.col(_AT)).alias(ts),
        F.col("__v").alias(value),
        (F.col("__cum") - F.col("__first")).alias(out),
    )


def counter_rate(
    samples: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    window: float = 30.0,
    out: str = "rate",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Per-second growth over the trailing ``window``."""
    grown = counter_increase(samples, series, ts, value, window, "__inc", target_rows)
    return grown.withColumn(out, F.col("__inc") / F.lit(float(window))).drop("__inc")


def counter_on_grid(
    samples: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    window: float = 30.0,
    step: float = 5.0,
    out: str = "increase",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Growth of a counter over the ``window`` seconds up to each evaluation instant, by the rules of ``counter_increase``.

    Instants are the multiples of ``step``; a series is evaluated where it has a sample in the (left-open) range, and ``value`` is the
    last one. A sample answers the instants from its own time until the next sample, or until it
    leaves the range: at most ``window / step`` of them, so nothing is joined. The first sample of each range is found by
    walking range starts and samples in one order. ``out`` over ``window`` is the rate.
    """
    rows, bounds = _cumulative(samples, series, ts, value, target_rows)
    span, width = _seconds(window), _seconds(step)
    rows = running_last(rows, series, [_AT], F.col(_AT), "__next", bounds, inclusive=False, reverse=True)
    ends = F.least(F.col(_AT) + span, F.coalesce("__next", F.col(_AT) + span)) - 1
    first = F.ceil(F.col(_AT) / F.lit(width)).cast("bigint")
    last = F.floor(ends / F.lit(width)).cast("bigint")
    instants = rows.where(first <= last).select(
        *series, F.explode(F.sequence(first, last)).alias("__k"), "__v", "__cum"
    )
    starts = instants.select(
        *series,
        (F.col("__k") * width - span).alias("pos"),
        F.lit(1).alias("role"),
        F.lit(None).cast("double").alias("first"),
        (F.col("__k") * width).alias(_AT),
        "__v",
        "__cum",
    )
    # Samples sort before range starts at the same time: a sample on the start is outside.
    seen = rows.select(
        *series,
        F.col(_AT).alias("pos"),
        F.lit(0).alias("role"),
        F.col("__cum").alias("first"),
        _AT,
        "__v",
        "__cum",
    )
    filled = running_last(
        seen.unionByName(starts), series, ["pos", "role"], F.col("first"), "__first", bounds, reverse=True
    )
    return filled.where(F.col("role") == 1).select(
        *series,
        from_micros(F.col(_AT)).alias(ts),
        F.col("__v").alias(value),
        (F.col("__cum") - F.col("__first")).alias(out),
    )


def rule_states(
    requests: DataFrame,
    errors: DataFrame,
    up: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    window: float = 30.0,
    step: float = 5.0,
    for_: float = 5.0,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """The three standing alerts on one evaluation grid: ``alert``, series, ``ts``, ``state``, ``active_since``.

    A counter of ``requests`` that grows, a counter of ``errors`` whose rate is above zero, and a
    target whose last ``up`` sample is 0; each fires once it holds for ``for_`` seconds.
    """
    grown = counter_on_grid(requests, series, ts, value, window, step, "__x", target_rows)
    rate = counter_on_grid(errors, series, ts, value, window, step, "__x", target_rows)
    down = target_down(up, series, ts, value, step)
    conditions = [
        # The alerts' names.
        ("HighCPUUsage", grown.withColumn("__on", F.col("__x") > 0)),
        ("HighErrorRate", rate.withColumn("__on", F.col("__x") / F.lit(float(window)) > 0)),
        ("ServiceDown", down.withColumn("__on", F.col("down"))),
    ]
    found = [rows.select(F.lit(name).alias("alert"), *series, ts, F.col("__on").alias("holds")) for name, rows in conditions]
    grid = found[0].unionByName(found[1]).unionByName(found[2])
    states = alert_states(grid, F.col("holds"), ["alert", *series], ts, for_, step, target_rows)
    return states.select("alert", *series, ts, "state", "active_since")


def evaluate_on_grid(
    samples: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    step: float = 5.0,
) -> DataFrame:
    """Last sample of each series in each ``step``, at the evaluation instant that ends the step."""
    width = _seconds(step)
    at = micros(F.col(ts))
    instant = F.ceil(at / F.lit(width)).cast("bigint") * width
    return (
        samples.select(*series, at.alias("__t"), F.col(value).alias("__v"), instant.alias(_AT))
        .groupBy(*series, _AT)
        .agg(F.max_by("__v", "__t").alias(value))
        .select(*series, from_micros(F.col(_AT)).alias(ts), value)
    )


def target_down(
    samples: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    step: float = 5.0,
) -> DataFrame:
    """Evaluation instants with the condition "the last sample is 0"."""
    grid = evaluate_on_grid(samples, series, ts, value, step)
    return grid.withColumn("down", F.coalesce(F.col(value) == 0, F.lit(False)))


def alert_states(
    df: DataFrame,
    condition: Column,
    series: Sequence[str],
    ts: str = "ts",
    for_: float = 5.0,
    step: float = 5.0,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """State of the alert at each evaluation: inactive, pending or firing.

    ``df`` has one row per series and evaluation instant. A condition that holds for at least
    ``for_`` seconds without a break is firing; an instant missing from the grid is a break.
    """
    rows = df.withColumn(_AT, micros(F.col(ts))).withColumn(
        "__on", F.coalesce(condition, F.lit(False))
    )
    bounds = plan_bounds(rows, _AT, target_rows)
    rows = island_starts(rows, series, _AT, "__on", "__since", bounds, max_step=_seconds(step))
    held = F.col(_AT) - F.col("__since") >= _seconds(for_)
    state = F.when(~F.col("__on"), "inactive").when(held, "firing").otherwise("pending")
    return (
        rows.withColumn("state", state)
        .withColumn("active_since", F.when(F.col("__on"), from_micros(F.col("__since"))))
        .drop(_AT, "__on", "__since")
    )


def alert_recovery(
    states: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    cooldown: float = 10.0,
    step: float = 1.0,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Firing episodes with their recovery.

    An episode recovers at the check that makes ``cooldown / step`` consecutive checks without
    firing; firing again before that continues the episode. ``recovered_at`` is null while open.
    """
    checks = max(1, round(cooldown / step))
    rows = states.select(
        *series, micros(F.col(ts)).alias(_AT), (F.col("state") == "firing").alias("__firing")
    )
    bounds = plan_bounds(rows, _AT, target_rows)
    runs = (
        island_starts(rows, series, _AT, "__firing", "__start", bounds)
        .groupBy(*series, "__start", "__firing")
        .agg(F.max(_AT).alias("__end"), F.count(F.lit(1)).alias("__n"))
    )
    quiet = ~F.col("__firing") & (F.col("__n") >= checks)
    # Runs between two long quiet ones share an episode; a long quiet run closes the one before it.
    runs = running_last(
        runs,
        series,
        ["__start"],
        F.when(quiet, F.col("__start")),
        "__episode",
        bounds,
        inclusive=False,
    )
    firing = F.col("__firing")
    closed = F.min(F.when(quiet, F.col("__start"))) + (checks - 1) * _seconds(step)
    return (
        runs.groupBy(*series, "__episode")
        .agg(
            from_micros(F.min(F.when(firing, F.col("__start")))).alias("firing_at"),
            from_micros(F.max(F.when(firing, F.col("__end")))).alias("last_firing_at"),
            from_micros(closed).alias("recovered_at"),
        )
        .where(F.col("firing_at").isNotNull())
        .drop("__episode")
    )
