"""Reading and writing tables, files and streams."""

from opswatch.sources.readers import (
    read_catalog,
    read_events_stream,
    read_experiment_logs,
    read_jsonl,
    read_jsonl_stream,
    read_log_dir_stream,
    read_semantic,
    read_structured,
)
from opswatch.sources.sinks import (
    anomaly_sink,
    debug_sink,
    start_sink,
    write_events_stream,
    write_partitioned,
    write_report,
    write_semantic,
)

__all__ = [
    "anomaly_sink",
    "debug_sink",
    "read_catalog",
    "read_events_stream",
    "read_experiment_logs",
    "read_jsonl",
    "read_jsonl_stream",
    "read_log_dir_stream",
    "read_semantic",
    "read_structured",
    "start_sink",
    "write_events_stream",
    "write_partitioned",
    "write_report",
    "write_semantic",
]
