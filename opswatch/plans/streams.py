"""Streaming queries: the events table read as a stream of files and run to its end.

Each writes to a new folder beside the session's checkpoints and returns what the sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch import schemas
from opswatch.functions import micros
from opswatch.operators.autoencoder import save_model
from opswatch.operators.envelope import parse_envelope, route_structured, semantic_rows
from opswatch.operators.labels import rule_labels
from opswatch.plans.events import ORACLES as EVENT_SQL
from opswatch.plans.tables import SQL_EVENTS, envelopes
from opswatch.plans.timing import _STATES, GRID, HOUR, _episodes_sql, _grid_sql, counter_samples
from opswatch.plans.timing import ORACLES as TIMING_SQL
from opswatch.plans.vectors import encode_sql, network_sql, tier_sql, written_network
from opswatch.session import ensure_checkpoint_dir
from opswatch.sources import read_structured, start_sink
from opswatch.streaming.alerts import alert_transitions, anomaly_sessions, counter_growth, first_detections
from opswatch.streaming.collect import collect_until
from opswatch.streaming.scoring import read_anomalies, score_stream

_ONCE = {"availableNow": True}
#: Bytes of files in one batch: a batch takes seconds to plan and commit, so batches follow the bytes and not the number of files.
_BATCH_BYTES = str(128 << 20)
#: Batches in which a table written by a stream is read as the next one.
_BATCHES = 4


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The events table as a stream of its files, whether it is one file or a folder of parts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _run_into(df: DataFrame, folder: str, by: tuple[str, ...] = ()) -> int:
    """Run a stream to the end of its input; returns the rows it has read."""
    query = start_sink(df, f"{folder}/out", f"{folder}/state", by, trigger=_ONCE)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _run(df: DataFrame, by: tuple[str, ...] = ()) -> str:
    folder = _folder(df.sparkSession)
    if not _run_into(df, folder, by):
        raise RuntimeError("the stream has read no row")
    return f"{folder}/out"


#: A table has no order of arrival: nothing in it is late, and everything is closed by a last row.
_NEVER_LATE, _END = "40000 days", "2250-01-01 00:00:00"


def _run_closed(spark: SparkSession, build, schema: str, end: str) -> str:
    """Run ``build(marks)`` to its end, then once more with one mark, so that the watermark passes every row.

    ``marks`` is a stream of ``schema`` that stays empty until then; ``end`` is its one row in SQL.
    """
    folder = _folder(spark)
    marks = f"{folder}/marks"
    closing = spark.sql(f"SELECT {end}").to(spark.createDataFrame([], schema).schema)
    closing.limit(0).write.parquet(marks)

    def once() -> int:
        return _run_into(build(spark.readStream.schema(schema).parquet(marks)), folder)

    if not once():
        raise RuntimeError("the stream has read no row")
    closing.write.mode("append").parquet(marks)
    once()
    return f"{folder}/out"


def stream_structured(spark, sf_dir):
    """Routing on a stream into a table partitioned by source."""
    envelope = parse_envelope(envelopes(_event_stream(spark, sf_dir)))
    path = _run(route_structured(envelope), ("source_type",))
    return read_structured(spark, path).groupBy("source_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("commit_email").alias("commits"),
        F.count("response_status").alias("accesses"),
        F.count("error_level").alias("web_errors"),
        F.count("value").alias("metrics"),
    )


def stream_semantic(spark, sf_dir):
    rows = semantic_rows(envelopes(_event_stream(spark, sf_dir)), keep=("event_id",))
    return spark.read.parquet(_run(rows.drop("json_str")))


def stream_labelled(spark, sf_dir):
    """A labelled test set collected from a stream, until every row is in."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    labelled = rule_labels(parse_envelope(envelopes(_event_stream(spark, sf_dir))))
    folder = _folder(spark)
    collect_until(
        labelled.select("source_type", "message", "json_str", "label"),
        rows,
        f"{folder}/out",
        f"{folder}/state",
        ("source_type",),
        trigger=_ONCE,
    )
    found = spark.read.schema(schemas.LABELLED).parquet(f"{folder}/out")
    return found.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("label").alias("anomalies")
    )


def stream_alerts(spark, sf_dir):
    """Alert changes of an hourly grid, kept as state per event type; both streams come in several batches.

    A series waits as a whole for the end of the grid and is handed from batch to batch, so the grid's batches are few at any size.
    """
    width = 3_600_000_000

    def grid(marks: DataFrame) -> DataFrame:
        hour = F.ceil(micros(F.col("ts")) / F.lit(width)).cast("bigint") * width
        events = _event_stream(spark, sf_dir, maxBytesPerTrigger=_BATCH_BYTES)
        rows = events.select("event_type", F.timestamp_micros(hour).alias("at"), "ts", "value")
        timed = rows.unionByName(marks).withWatermark("at", _NEVER_LATE)
        return timed.groupBy("event_type", "at").agg(F.max_by("value", "ts").alias("value"))

    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.simpleString()
    end = f"'' AS event_type, TIMESTAMP'{_END}' AS at, TIMESTAMP'{_END}' AS ts, 0D AS value"
    path = _run_closed(spark, grid, f"event_type string, at timestamp, ts {kind}, value double", end)
    files = len(spark.read.parquet(path).inputFiles())

    def changes(marks: DataFrame) -> DataFrame:
        # The grid is complete before it is read as the stream of evaluations.
        stream = spark.readStream.schema("event_type string, at timestamp, value double")
        instants = stream.option("maxFilesPerTrigger", max(4, -(-files // _BATCHES))).parquet(path).unionByName(marks)
        return alert_transitions(
            instants,
            F.col("value") > 20,
            "event_type",
            "at",
            for_=2 * HOUR,
            step=HOUR,
            cooldown_checks=3,
            late=_NEVER_LATE,
        )

    end = f"'' AS event_type, TIMESTAMP'{_END}' AS at, 0D AS value"
    found = spark.read.parquet(
        _run_closed(spark, changes, "event_type string, at timestamp, value double", end)
    )
    return found.select("event_type", micros(F.col("at")).alias("ts_us"), "state")


def stream_sessions(spark, sf_dir):
    """Error episodes as sessions, all of them closed at the end of the table."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.simpleString()

    def sessions(marks: DataFrame) -> DataFrame:
        events = _event_stream(spark, sf_dir, maxBytesPerTrigger=_BATCH_BYTES)
        errors = events.where(F.col("event_type") == "error").select("ts")
        return anomaly_sessions(errors.unionByName(marks), gap=1800, grace=5, late=_NEVER_LATE)

    found = spark.read.parquet(
        _run_closed(spark, sessions, f"ts {kind}", f"TIMESTAMP'{_END}' AS ts")
    )
    return found.select(
        micros(F.col("first_anomaly")).alias("first_us"),
        micros(F.col("last_anomaly")).alias("last_us"),
        "anomalies",
        micros(F.col("recovered_at")).alias("recovered_us"),
    )


#: Of the written network over texts; about half of the events are above it.
_THRESHOLD = 0.066


def stream_scores(spark, sf_dir):
    """Events scored as a stream by a published model, and the anomaly log read back."""
    folder = _folder(spark)
    save_model(written_network(schemas.EMBEDDING_DIM, _THRESHOLD), spark, f"{folder}/models")
    events = envelopes(_event_stream(spark, sf_dir))
    query = score_stream(
        events, f"{folder}/models", f"{folder}/log", f"{folder}/state", keep=("event_id",), trigger=_ONCE
    )
    query.awaitTermination()
    found = read_anomalies(spark, f"{folder}/log", "event_id long")
    return found.select("event_id", "source_type", "semantic_text", "prediction", "mse", "threshold")


def _counters(spark, sf_dir) -> str:
    """Event values as counters on the hourly grid, worked out as a stream."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.simpleString()
    schema = f"event_type string, instance long, ts {kind}, value double, k int"

    def grown(marks: DataFrame) -> DataFrame:
        samples = counter_samples(_event_stream(spark, sf_dir, maxBytesPerTrigger=_BATCH_BYTES))
        return counter_growth(
            samples.unionByName(marks), ["event_type", "instance"], late=_NEVER_LATE, **GRID
        )

    end = f"'' AS event_type, 0L AS instance, TIMESTAMP'{_END}' AS ts, 0D AS value, 0 AS k"
    return _run_closed(spark, grown, schema, end)


def stream_counters(spark, sf_dir):
    """The rows of the batch grid, from a stream."""
    found = spark.read.parquet(_counters(spark, sf_dir))
    return found.select(
        "event_type", F.col("instance").cast("long").alias("instance"), micros(F.col("ts")).alias("ts_us"),
        "value", F.round("increase", 4).alias("increase"),
    )


def stream_counter_alerts(spark, sf_dir):
    """Changes of the alert "the counter grows" of each series, from the stream of counters."""
    path = _counters(spark, sf_dir)
    schema = "series string, ts timestamp, increase double"

    def changes(marks: DataFrame) -> DataFrame:
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        series = F.concat_ws("/", "event_type", "instance").alias("series")
        rows = stream.select(series, "ts", "increase").unionByName(marks)
        return alert_transitions(
            rows, F.col("increase") > 0, "series", for_=HOUR, step=HOUR, cooldown_checks=3, late=_NEVER_LATE
        )

    end = f"'' AS series, TIMESTAMP'{_END}' AS ts, 0D AS increase"
    found = spark.read.parquet(_run_closed(spark, changes, schema, end))
    return found.select("series", micros(F.col("ts")).alias("ts_us"), "state")


def stream_first_detection(spark, sf_dir):
    """The first error of a user after each signup, from two streams."""

    def detections(marks: DataFrame) -> DataFrame:
        rows = _event_stream(spark, sf_dir, maxBytesPerTrigger=_BATCH_BYTES)
        errors = rows.where("event_type = 'error'").select("user_id", "ts").unionByName(marks)
        signups = _event_stream(spark, sf_dir, maxBytesPerTrigger=_BATCH_BYTES).where("event_type = 'signup'")
        injections = signups.select("user_id", F.col("ts").alias("injected_at"))
        return first_detections(errors, injections, ["user_id"], horizon="4000 day", late=_NEVER_LATE)

    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.simpleString()
    path = _run_closed(spark, detections, f"user_id long, ts {kind}", f"-1L AS user_id, TIMESTAMP'{_END}' AS ts")
    found = spark.read.parquet(path)
    return found.select(
        "user_id", micros(F.col("injected_at")).alias("injected_us"), micros(F.col("detected_at")).alias("detected_us")
    )


QUERIES = {
    "stream_structured": stream_structured,
    "stream_semantic": stream_semantic,
    "stream_labelled": stream_labelled,
    "stream_alerts": stream_alerts,
    "stream_sessions": stream_sessions,
    "stream_scores": stream_scores,
    "stream_counters": stream_counters,
    "stream_counter_alerts": stream_counter_alerts,
    "stream_first_detection": stream_first_detection,
}


def _changes_sql(key: str) -> str:
    """Changes of ``st(key, t, state)``, and recoveries after three evaluations without firing."""
    return f"""c AS (SELECT {key}, t, state,
             lag(state, 1, 'inactive') OVER (PARTITION BY {key} ORDER BY t) AS before FROM st),
b AS (SELECT {key}, t, state = 'firing' AS f FROM st),
q AS (SELECT *, lag(f) OVER (PARTITION BY {key} ORDER BY t) AS pf FROM b),
r AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf <> f THEN 1 ELSE 0 END)
        OVER (PARTITION BY {key} ORDER BY t) AS run FROM q),
runs AS (SELECT {key}, run, f, count(*) AS n FROM r GROUP BY {key}, run, f),
ep AS (SELECT *, count(*) FILTER (WHERE NOT f AND n >= 3) OVER (PARTITION BY {key} ORDER BY run
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM runs),
rec AS (SELECT {key}, min(run) FILTER (WHERE NOT f AND n >= 3) AS run FROM ep
        GROUP BY {key}, e HAVING count(*) FILTER (WHERE f) > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY {key}, run ORDER BY t) AS nth FROM r)
SELECT {key}, t AS ts_us, state FROM c WHERE state <> before
UNION ALL SELECT {key}, t, 'recovered' FROM num JOIN rec USING ({key}, run) WHERE nth = 3"""


ORACLES = {
    "stream_structured": EVENT_SQL["route_structured_counts"],
    "stream_semantic": EVENT_SQL["semantic_text"],
    "stream_labelled": f"""WITH l AS ({EVENT_SQL["rule_labels"]}),
p AS ({EVENT_SQL["parse_envelope"]})
SELECT source_type, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS anomalies
FROM l JOIN p USING (event_id) GROUP BY source_type""",
    "stream_alerts": f"WITH {_STATES},\n{_changes_sql('event_type')}",
    "stream_sessions": _episodes_sql(None, 1800, 5, None),
    "stream_scores": f"""WITH texts AS ({EVENT_SQL["semantic_text"]}),
{encode_sql("event_id", "texts", "semantic_text")},
every AS (SELECT event_id, dim, coalesce(x, 0.0) AS x
          FROM texts CROSS JOIN (SELECT unnest(range({schemas.EMBEDDING_DIM})) AS dim) LEFT JOIN vec USING (event_id, dim)),
{network_sql("event_id", "every")}
SELECT event_id, source_type, semantic_text, {tier_sql(_THRESHOLD)} AS prediction, round(mse, 6) AS mse,
       {_THRESHOLD}::DOUBLE AS threshold
FROM e JOIN texts USING (event_id) WHERE mse / {_THRESHOLD} > 1""",
    "stream_counters": TIMING_SQL["counter_on_grid"],
    "stream_first_detection": TIMING_SQL["first_detection"],
    "stream_counter_alerts": f"""WITH {SQL_EVENTS},
{_grid_sql("1", "true")},
cond AS (SELECT event_type || '/' || instance AS series, t, increase > 0 AS holds FROM g1),
o AS (SELECT *, lag(holds) OVER w AS pc, lag(t) OVER w AS pt FROM cond WINDOW w AS (PARTITION BY series ORDER BY t)),
i AS (SELECT *, max(CASE WHEN pc IS NULL OR pc <> holds OR t - pt > 3600000000 THEN t END)
        OVER (PARTITION BY series ORDER BY t) AS since FROM o),
st AS (SELECT series, t, CASE WHEN NOT holds THEN 'inactive' WHEN t - since >= 3600000000 THEN 'firing' ELSE 'pending' END AS state FROM i),
{_changes_sql("series")}""",
}
