"""Streams whose micro-batches are killed and replayed, and versions published under their readers."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from opswatch import schemas, sources
from opswatch.operators.autoencoder import initial, load_model, save_model
from opswatch.operators.catalogue import indexed_candidates, load_index, publish_index
from opswatch.operators.labels import new_feedback_stream
from opswatch.operators.rootcause import with_candidates
from opswatch.operators.scoring import SemanticBundle, anomalies_only, score_events
from opswatch.streaming import batches
from opswatch.streaming.rootcause import encode_services, root_cause, root_cause_stream
from opswatch.streaming.scoring import read_anomalies, score_stream
from opswatch.versions import publish, published, versions

ONCE = {"availableNow": True}


def model(seed, threshold):
    net = initial(schemas.EMBEDDING_DIM, 4, seed)
    net.threshold = threshold
    return net


@pytest.fixture
def killed(monkeypatch):
    """Fails the stream once, after its batch is written (or half written) and before it is committed."""
    left = {"fail": None}
    plain = batches.write_once

    def wrapped(*args, **kwargs):
        run = plain(*args, **kwargs)

        def then(df, batch):
            if left["fail"] == "before":
                left["fail"] = None
                work = args[2]
                version = batches._version_of(df.sparkSession, args[0], batch, args[1])
                work(df, version).limit(1).write.format("json").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").save(
                    f"{args[0]}/batch={batch}"
                )
                raise RuntimeError("killed")
            run(df, batch)
            if left["fail"] == "after":
                left["fail"] = None
                raise RuntimeError("killed")

        return then

    monkeypatch.setattr(batches, "write_once", wrapped)
    return left


@pytest.mark.parametrize("moment", ["before", "after"])
def test_scores_survive_a_killed_batch(spark, tmp_path, killed, moment):
    folder, models, log = tmp_path / "in", str(tmp_path / "models"), str(tmp_path / "log")
    folder.mkdir()

    def lines(part):
        return [json.dumps({"source_type": "app_container_log", "message": json.dumps({"message": f"m{part} {i}"})}) for i in range(20)]

    def run():
        stream = sources.read_events_stream(spark, "text", str(folder), maxFilesPerTrigger="1")
        query = score_stream(stream, models, log, str(tmp_path / "state"), trigger=ONCE)
        query.awaitTermination()

    first = model(0, 1.0)
    save_model(first, spark, models)
    probe = score_events(spark.createDataFrame([(e,) for e in lines(0)], "json_str string"), SemanticBundle(first))
    first.threshold = sorted(r.mse for r in probe.collect())[8]
    save_model(first, spark, models)
    (folder / "0.txt").write_text("\n".join(lines(0)) + "\n")
    killed["fail"] = moment
    with pytest.raises(StreamingQueryException, match="killed"):
        run()
    # a new version does not change the batch that was begun; the next one takes it
    second = model(5, first.threshold / 2)
    save_model(second, spark, models)
    run()
    (folder / "1.txt").write_text("\n".join(lines(1)) + "\n")
    run()
    want = []
    for part, net in ((0, first), (1, second)):
        scored = score_events(spark.createDataFrame([(e,) for e in lines(part)], "json_str string"), SemanticBundle(net))
        want += rows(anomalies_only(scored), "semantic_text", "prediction", "mse", "threshold")
    got = rows(read_anomalies(spark, log), "semantic_text", "prediction", "mse", "threshold")
    assert got == sorted(want) and 0 < len(got) < 40


def test_a_log_without_batches_is_empty(spark, tmp_path):
    assert read_anomalies(spark, str(tmp_path / "none"), "event_id long").columns[0] == "event_id"
    assert read_anomalies(spark, str(tmp_path / "none")).count() == 0


def services(spark, n, dim=6):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (n, dim)).astype(float)
    data = [(f"s{i}", i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*data, ("none", n, None), ("short", n + 1, [1.0])], "service_name string, ord long, vector array<double>")


def test_blocks_find_what_one_matrix_finds(spark, tmp_path):
    known = services(spark, 60)
    path = str(tmp_path / "index")
    publish_index(known, path, block=7)
    rng = np.random.default_rng(5)
    data = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (40, 6)).astype(float))]
    asked = spark.createDataFrame([*data, (100, None), (101, [1.0, 2.0]), (0, data[0][1])], "id long, embedding array<double>")
    got = indexed_candidates(asked.repartition(3), load_index(spark, path), slice_rows=5)
    assert load_index(spark, path).count() > 8

    def table(df):
        found = df.select("id", F.transform("candidates", lambda c: F.struct(c["entity"], F.round(c["confidence"], 9))).alias("c"))
        return sorted(str(r) for r in found.collect())

    full = known.where(F.size("vector") == 6)
    assert table(got) == table(with_candidates(asked, full))


def test_root_causes_of_a_stream_and_a_large_catalogue(spark, tmp_path, killed):
    names = [f"svc-{i}" for i in range(50)]
    encoded = encode_services(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "service_name string, ord long"))
    index, out = str(tmp_path / "index"), str(tmp_path / "out")
    publish_index(encoded, index, block=9)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"semantic_text": f"svc-{i} is down", "feedback_label": "true" if i % 3 else "no"} for i in range(12)]
    (folder / "f.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    batch = root_cause(spark.createDataFrame([(x["semantic_text"], x["feedback_label"]) for x in lines], "semantic_text string, feedback_label string"), encoded)

    def run():
        stream = sources.read_jsonl_stream(spark, str(folder), schemas.FEEDBACK)
        root_cause_stream(stream, index, out, str(tmp_path / "state"), trigger=ONCE).awaitTermination()
        return stream

    killed["fail"] = "after"
    with pytest.raises(StreamingQueryException, match="killed"):
        run()
    kept = run().schema
    found = batches.read_batches(spark, out, kept.add("candidates", batch.schema["candidates"].dataType))

    def table(df):
        return sorted((r.semantic_text, [c.entity for c in r.candidates]) for r in df.collect())

    assert table(found) == table(batch) and len(table(found)) == 8


def test_no_feedback_line_twice_across_a_restart(spark, tmp_path):
    t0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def add(*lines):
        data = [(line, t0 + timedelta(hours=h)) for line, h in lines]
        spark.createDataFrame(data, "value string, timestamp timestamp").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema("value string, timestamp timestamp").parquet(folder)
        query = sources.start_sink(new_feedback_stream(stream, remember="1 day"), out, str(tmp_path / "state"), trigger=ONCE)
        query.awaitTermination()
        return query

    add(("a", 0), ("b", 0), ("a", 1), (" ", 1))
    run()
    add(("a", 2), ("c", 2))
    run()
    add(("d", 100))
    add(("d", 101))
    query = run()
    assert rows(spark.read.parquet(out), "value") == [("a",), ("b",), ("c",), ("d",)]
    # lines that can no longer recur are forgotten
    run()
    add(("e", 200))
    query = run()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_reader_during_a_save_gets_a_whole_version(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        published(spark, path)
    first = model(1, 0.5)
    assert save_model(first, spark, path) == 1

    class Broken(Exception):
        pass

    def failing(_):
        raise Broken

    # a second writer stops half way: its version is never seen, and its number not used again
    broken = spark.range(3).mapInPandas(failing, "id long")
    with pytest.raises(Exception, match="Broken"):
        publish(spark, path, {"model": broken})
    assert versions(spark, path) == [1] and load_model(spark, path).threshold == 0.5
    held = spark.read.parquet(published(spark, path)["model"])
    assert save_model(model(2, 0.7), spark, path) == 3
    assert load_model(spark, path).threshold == 0.7 and load_model(spark, path, 1).threshold == 0.5
    assert held.first()["threshold"] == 0.5


def test_debug_sink_shows_some_rows_of_each_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("".join(f"line {i}\n" for i in range(9)))
    query = sources.debug_sink(sources.read_events_stream(spark, "text", str(folder)), 5)
    query.processAllAvailable()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    assert [p["numInputRows"] for p in done] == [9] and query.exception() is None
    assert "ConsoleTable" in done[0]["sink"]["description"]


def test_anomaly_sink_keeps_anomalies(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(json.dumps({"source_type": "x", "message": f"m {i}"}) for i in range(10)) + "\n")
    net = model(0, 1e-9)
    events = sources.read_events_stream(spark, "text", str(folder))
    out = str(tmp_path / "out")
    sources.anomaly_sink(score_events(events, SemanticBundle(net)), out, str(tmp_path / "cp"), ONCE).awaitTermination()
    found = spark.read.json(out)
    assert found.count() == 10 and {r.prediction for r in found.collect()} == {"high_anomaly"}
    # the time of scoring is there beside the event's own
    assert found.where("scored_at is null or timestamp is null").count() == 0
