"""Sinks, batch and streaming.

Streaming tables use the file sink: its commit log makes a restarted query neither lose nor repeat
a batch, so nothing is written from inside callbacks or functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from opswatch.functions import record_json
from opswatch.operators.scoring import anomalies_only


def start_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to files; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = df.writeStream.outputMode("append").format(fmt)
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.start()


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("source_type",), mode: str = "append"
) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_semantic(df: DataFrame, path: str, mode: str = "append") -> None:
    columns = ("source_type", "ingest_time", "semantic_text", "embedding")
    df.select(*columns).write.mode(mode).parquet(path)


def debug_sink(df: DataFrame, n: int = 5) -> StreamingQuery:
    """Print the first ``n`` rows of each batch, untruncated."""
    writer = df.writeStream.outputMode("append").format("console")
    return writer.option("truncate", False).option("numRows", n).start()


def anomaly_sink(
    scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append the rows tiered as anomalies to JSON-lines files."""
    return start_sink(anomalies_only(scored), path, checkpoint, fmt="json", trigger=trigger)


def write_report(df: DataFrame, path: str) -> None:
    """A small table (one row per model or system) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_events_stream(
    df: DataFrame, fmt: str, checkpoint: str, trigger: dict | None = None, **options: str
) -> StreamingQuery:
    """Publish rows as JSON in a ``value`` column: to a topic, or to files when testing."""
    writer = df.select(record_json(df).alias("value")).writeStream.outputMode("append")
    writer = writer.format(fmt).option("checkpointLocation", checkpoint).options(**options)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
