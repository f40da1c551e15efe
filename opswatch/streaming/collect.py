"""Bounded collection: run a sink until enough rows are committed."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opswatch.sources.sinks import start_sink

# Rows collected for training and for the labelled set, and the time limit.
TRAINING_ROWS, TEST_ROWS, TIMEOUT_SECONDS = 5_000, 1_000, 36_000


def collect_until(
    df: DataFrame,
    rows: int,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    timeout: float = TIMEOUT_SECONDS,
    poll: float = 0.5,
    trigger: dict | None = None,
) -> int:
    """Append a stream to Parquet until at least ``rows`` rows are committed; returns their number.

    Rows are counted by an observed metric while they are written, so a batch is evaluated once.
    The query is stopped from outside after a commit; a restart continues without duplicates.
    """
    counted = df.observe("collected", F.count(F.lit(1)).alias("rows"))
    query = start_sink(counted, path, checkpoint, partition_by, trigger=trigger)
    per_batch: dict[int, int] = {}
    deadline = time.monotonic() + timeout
    try:
        while True:
            active = query.isActive
            _read_progress(query, per_batch)
            total = sum(per_batch.values())
            if total >= rows or not active or time.monotonic() >= deadline:
                break
            query.awaitTermination(poll)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    _read_progress(query, per_batch)
    return sum(per_batch.values())


def _read_progress(query: StreamingQuery, per_batch: dict[int, int]) -> None:
    for progress in query.recentProgress:
        observed = progress["observedMetrics"].get("collected")
        if observed is not None:
            per_batch[progress["batchId"]] = observed["rows"]
