"""Scoring of an event stream into the anomaly log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opswatch.operators.autoencoder import load_model
from opswatch.operators.scoring import SemanticBundle, anomalies_only, score_events
from opswatch.streaming.batches import read_batches, start_batches

_SCORED = (
    "anomaly_id long, source_type string, ingest_time string, scored_at timestamp, timestamp string, "
    "semantic_text string, prediction string, mse double, threshold double, error string"
)


def score_stream(
    events: DataFrame,
    models: str,
    path: str,
    checkpoint: str,
    col: str = "json_str",
    encoder: Callable[[], Any] | None = None,
    text_mode: str = "native",
    keep: Sequence[str] = (),
    every_row: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score a stream of events and append its anomalies (or, with ``every_row``, all rows) to the log at ``path``.

    ``models`` is where ``save_model`` publishes; a new version is taken up by the next batch. Each batch is in the log once, and
    scored by one version, whatever is killed and replayed. ``read_anomalies`` reads the log.
    """

    def work(rows: DataFrame, version: int) -> DataFrame:
        model = load_model(rows.sparkSession, models, version)
        scored = score_events(rows, SemanticBundle(model, encoder, text_mode), col, keep)
        return scored if every_row else anomalies_only(scored)

    return start_batches(events, path, checkpoint, models, work, "json", trigger)


def read_anomalies(spark: SparkSession, path: str, keep: str = "") -> DataFrame:
    """The rows of the log; ``keep`` is the schema of the columns that were carried along."""
    return read_batches(spark, path, f"{keep}, {_SCORED}" if keep else _SCORED, "json")
