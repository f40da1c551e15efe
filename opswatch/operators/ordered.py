"""Running values over long ordered groups, split so that no task holds a whole group.

A window over ``PARTITION BY series ORDER BY ts`` puts a series into one task. Here the time axis
is cut into chunks at quantiles of the data, so a chunk holds a bounded share of the rows however
they are spread over series or time. One summary row per (series, chunk) is windowed over the
series; the result goes back into each chunk as a header row that sorts first, and rows are
windowed within (series, chunk). Each operator shuffles its rows once and joins nothing.
Chunk bounds only steer the balance: any bounds give the same result. Small inputs get no bounds
and the plan is then one ordinary window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000
MAX_CHUNKS = 8_192
CHUNK = "__chunk"
_SPLIT = "__split"
_HEADER = "__header"

Bounds = tuple[float, ...]


def plan_bounds(df: DataFrame, order: str, target_rows: int = TARGET_ROWS) -> Bounds:
    """Cut points of the numeric ``order`` column giving about ``target_rows`` rows per chunk.

    Two small jobs over one column; at most ``MAX_CHUNKS`` numbers reach the driver.
    """
    rows = df.select(order).count()
    chunks = min(MAX_CHUNKS, -(-rows // target_rows))
    if chunks <= 1:
        return ()
    cuts = [i / chunks for i in range(1, chunks)]
    found = df.agg(F.percentile_approx(order, cuts, 10 * chunks).alias("cuts")).first()["cuts"]
    return tuple(sorted({float(c) for c in found or []}))


def with_chunk(df: DataFrame, order: str, bounds: Bounds) -> DataFrame:
    """Add the chunk number of each row; it grows with ``order``."""
    if not bounds:
        return df.withColumn(CHUNK, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    bucketizer = Bucketizer(
        splits=splits, inputCol=_SPLIT, outputCol="__bucket", handleInvalid="keep"
    )
    return (
        bucketizer.transform(df.withColumn(_SPLIT, F.col(order).cast("double")))
        .withColumn(CHUNK, F.col("__bucket").cast("int"))
        .drop(_SPLIT, "__bucket")
    )


def _ordering(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _preceding_chunks(keys: Sequence[str], reverse: bool):
    chunk = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def _scan(
    rows: DataFrame,
    headers: DataFrame,
    keys: Sequence[str],
    ordering: list[Column],
    end: int,
    combine: Callable[[Column], Column],
    out: str,
) -> DataFrame:
    """Combine ``__value`` along each chunk, starting from the chunk's header row."""
    headers = headers.select(*keys, CHUNK, "__value", F.lit(1).alias(_HEADER))
    both = rows.withColumn(_HEADER, F.lit(0)).unionByName(headers, allowMissingColumns=True)
    frame = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(F.col(_HEADER).desc(), *ordering)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    return (
        both.withColumn(out, combine(F.col("__value")).over(frame))
        .where(F.col(_HEADER) == 0)
        .drop(_HEADER, "__value", CHUNK)
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    bounds: Bounds = (),
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Add the last non-null ``value`` at (or, exclusive, before) each row of its group.

    ``reverse`` walks the order backwards, giving the next value instead. The first order column
    is the numeric one that ``bounds`` cut.
    """
    end = 0 if inclusive else -1
    ordering = _ordering(order, reverse)

    def last(column: Column) -> Column:
        return F.last(column, ignorenulls=True)

    if not bounds:
        frame = (
            Window.partitionBy(*keys)
            .orderBy(*ordering)
            .rowsBetween(Window.unboundedPreceding, end)
        )
        return df.withColumn(out, last(value).over(frame))

    rows = with_chunk(df.withColumn("__value", value), order[0], bounds)
    seen = F.when(F.col("__value").isNotNull(), F.struct(*order))
    pick = F.min_by if reverse else F.max_by
    summary = rows.groupBy(*keys, CHUNK).agg(pick("__value", seen).alias("__last"))
    headers = summary.withColumn(
        "__value", last(F.col("__last")).over(_preceding_chunks(keys, reverse))
    )
    return _scan(rows, headers, keys, ordering, end, last, out)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    bounds: Bounds = (),
) -> DataFrame:
    """Add the sum of ``value`` up to and including each row of its group."""
    ordering = _ordering(order, False)
    if not bounds:
        frame = (
            Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
        )
        return df.withColumn(out, F.sum(value).over(frame))

    rows = with_chunk(df.withColumn("__value", value), order[0], bounds)
    summary = rows.groupBy(*keys, CHUNK).agg(F.sum("__value").alias("__total"))
    headers = summary.withColumn("__value", F.sum("__total").over(_preceding_chunks(keys, False)))
    return _scan(rows, headers, keys, ordering, 0, F.sum, out)


def island_starts(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    state: str,
    out: str,
    bounds: Bounds = (),
    max_step: int | None = None,
) -> DataFrame:
    """Add the ``order`` value at which the current run of equal ``state`` began.

    A distance above ``max_step`` between neighbours ends a run as a change of state does.
    """
    rows = running_last(
        df,
        keys,
        [order],
        F.struct(F.col(order).alias("at"), F.col(state).alias("state")),
        "__prev",
        bounds,
        inclusive=False,
    )
    broken = F.col("__prev").isNull() | ~F.col("__prev.state").eqNullSafe(F.col(state))
    if max_step is not None:
        broken = broken | (F.col(order) - F.col("__prev.at") > max_step)
    return running_last(
        rows, keys, [order], F.when(broken, F.col(order)), out, bounds
    ).drop("__prev")
