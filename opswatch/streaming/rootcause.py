"""Root-cause candidates for each newly confirmed anomaly."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from opswatch.operators.catalogue import indexed_candidates, load_index
from opswatch.operators.encode import encode
from opswatch.operators.labels import confirmed
from opswatch.operators.rootcause import with_candidates
from opswatch.schemas import EMBEDDING_DIM
from opswatch.streaming.batches import start_batches


def encode_services(
    catalog: DataFrame, encoder: Callable[[], Any] | None = None, dim: int = EMBEDDING_DIM
) -> DataFrame:
    """``service_name, ord, vector``: services are encoded by their name only."""
    named = encode(catalog.select("service_name", "ord"), "service_name", "vector", encoder, dim)
    return named.select("service_name", "ord", "vector")


def root_cause(
    feedback: DataFrame,
    services: DataFrame,
    k: int = 3,
    encoder: Callable[[], Any] | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Feedback rows or stream to its confirmed rows with ``candidates``, best first.

    On a stream the file source's checkpoint remembers what was handled. ``services`` is a table
    from ``encode_services``; it is fetched once, after a check of its size.
    """
    rows = encode(confirmed(feedback, strict=False), encoder=encoder, dim=dim)
    return with_candidates(rows, services, k).drop("embedding")


def root_cause_stream(
    feedback: DataFrame,
    index: str,
    path: str,
    checkpoint: str,
    k: int = 3,
    encoder: Callable[[], Any] | None = None,
    dim: int = EMBEDDING_DIM,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the confirmed rows of a feedback stream with ``candidates`` from a catalogue of any size.

    ``index`` is where ``publish_index`` wrote the services of ``encode_services``; each micro-batch meets its blocks, under the newest
    version when the batch was first begun. Each batch is written once; ``read_batches`` reads ``path``.
    """

    def work(rows: DataFrame, version: int) -> DataFrame:
        asked = encode(confirmed(rows, strict=False), encoder=encoder, dim=dim)
        return indexed_candidates(asked, load_index(rows.sparkSession, index, version), k).drop("embedding")

    return start_batches(feedback, path, checkpoint, index, work, trigger=trigger)
