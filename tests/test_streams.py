"""Streams over folders of many files."""

from pyspark.sql import functions as F

from opswatch.plans import streams


def test_small_files_share_batches(spark, tmp_path, monkeypatch):
    hours = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1800)
    rows = spark.range(240).select(
        F.col("id").alias("event_id"), hours.alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.concat(F.lit("kind-"), F.col("id") % 3).alias("event_type"),
        (F.col("id") % 50).cast("double").alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    rows.repartition(12).write.parquet(f"{tmp_path}/many/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")
    batches = []

    def started(*args, **settings):
        query = start(*args, **settings)
        query.awaitTermination()
        batches.append(sum(p["numInputRows"] > 0 for p in query.recentProgress))
        return query

    start = streams.start_sink
    monkeypatch.setattr(streams, "start_sink", started)
    many = sorted(map(tuple, streams.stream_alerts(spark, f"{tmp_path}/many").collect()))
    # events, their closing mark, instants, their closing mark: files, and not rows, would make 12 batches of the first
    assert len(batches) == 4 and max(batches) <= streams._BATCHES and batches[0] == 1
    assert many and many == sorted(map(tuple, streams.stream_alerts(spark, f"{tmp_path}/one").collect()))
