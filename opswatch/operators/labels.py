"""Labels: rules on raw events, keyword predicates and people's feedback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions import record_json
from opswatch.session import cut_lineage

# Up to this many timestamps of labels are broadcast; more are met by a shuffle.
BROADCAST_KEYS = 500_000

# Fixed values: (source, texts one of which makes the lower-cased message an anomaly).
DEFAULT_RULES: list[tuple[str, list[str]]] = [
    ("app_container_log", ["error", "unreachable"]),
    ("nginx_access", ['"status":500']),
]
FULL_RULES: list[tuple[str, list[str]]] = DEFAULT_RULES + [
    ("nginx_access", ['"status": 500']),
    ("nginx_error", ["error"]),
    ("fastapi_status", ["unreachable", "timed out"]),
]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rule_labels(df: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Add ``label``: 1 where a rule of the row's source matches its message, else 0."""
    message = F.lower(F.col("message"))
    hits = [
        (F.col("source_type") == source) & any_of([message.contains(t) for t in texts])
        for source, texts in (DEFAULT_RULES if rules is None else rules)
    ]
    return df.withColumn("label", F.when(any_of(hits), 1).otherwise(0))


def matches_keywords(df: DataFrame, keywords: Sequence[str]) -> Column:
    """Any keyword occurs in the text, else the message, else the whole record; no keyword: true."""
    if not keywords:
        return F.lit(True)
    candidates = [
        F.nullif(F.col(c), F.lit("")) for c in ("semantic_text", "message") if c in df.columns
    ]
    text = F.lower(F.coalesce(*candidates, record_json(df)))
    return any_of([text.contains(k.lower()) for k in keywords])


def valid_anomalies(df: DataFrame, keywords: Sequence[str] = ()) -> DataFrame:
    """Rows tiered as anomalies that match the keywords."""
    tiered = F.col("prediction").isin("high_anomaly", "low_anomaly")
    return df.where(tiered & matches_keywords(df, keywords))


def confirmed(df: DataFrame, strict: bool = True) -> DataFrame:
    """Rows people confirmed; ``strict=False`` ignores case but requires a text."""
    if strict:
        return df.where(F.col("feedback_label") == "true")
    text = F.coalesce(F.col("semantic_text"), F.lit(""))
    return df.where((F.lower(F.col("feedback_label")) == "true") & (text != ""))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, "__row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, "__row.*")


def apply_feedback(
    anomalies: DataFrame, labels: DataFrame, order: str, key: str = "timestamp"
) -> DataFrame:
    """Each label with the first anomaly of its timestamp, as feedback rows.

    ``labels`` has ``key, feedback_label`` and optionally ``root_cause``. Only the anomalies a
    label asks for are shuffled, and those are reduced to one per timestamp before the join.
    """
    if "root_cause" not in labels.columns:
        labels = labels.withColumn("root_cause", F.lit(None).cast("string"))
    cause = F.nullif(F.col("root_cause"), F.lit(""))
    wanted = labels.select(key, "feedback_label", cause.alias("root_cause"))
    # labels are written by people; their timestamps are broadcast when their count allows
    asked = cut_lineage(wanted.select(key).distinct())
    few = asked.count() <= BROADCAST_KEYS
    kept = anomalies.join(F.broadcast(asked) if few else asked, key, "left_semi")
    found = first_per_key(kept, [key], order)
    return found.drop("feedback_label", "root_cause", order).join(wanted, key)


def unmatched_labels(anomalies: DataFrame, labels: DataFrame, key: str = "timestamp") -> DataFrame:
    """Labels whose timestamp no anomaly has."""
    return labels.join(anomalies.select(key).distinct(), key, "left_anti")


def new_feedback(current: DataFrame, processed: DataFrame | None, line: str = "value") -> DataFrame:
    """Feedback lines not handled before, each once; blank lines are not feedback."""
    fresh = current.where(F.trim(F.col(line)) != "").dropDuplicates([line])
    if processed is None:
        return fresh
    return fresh.join(processed.select(line).distinct(), line, "left_anti")


def new_feedback_stream(
    lines: DataFrame, ts: str = "timestamp", line: str = "value", remember: str = "7 days"
) -> DataFrame:
    """A stream of feedback lines, each once: its state is kept by the hash of the line for ``remember`` of event time, then removed.

    A restart from the checkpoint goes on with that state. Lines older than ``remember`` behind the newest are late and left out.
    """
    timed = lines.where(F.trim(F.col(line)) != "").withColumn(ts, F.col(ts).cast("timestamp"))
    keyed = timed.withColumn("__line", F.sha2(F.col(line), 256)).withWatermark(ts, remember)
    return keyed.dropDuplicatesWithinWatermark(["__line"]).drop("__line")
