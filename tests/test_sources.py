"""Envelopes, collector records, files and streams."""

import json
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opswatch import schemas, sources
from opswatch.operators.envelope import (
    parse_envelope,
    route_for_scoring,
    route_structured,
    semantic_rows,
    source_rows,
    union_sources,
)
from opswatch.operators.episodes import anomaly_episodes
from opswatch.operators.labels import FULL_RULES, rule_labels
from opswatch.operators.normalize import classify_health, flatten_commits, flatten_metrics, flatten_runs, keep_metrics
from opswatch.streaming.alerts import alert_transitions, anomaly_sessions
from opswatch.streaming.collect import collect_until
from opswatch.streaming.rootcause import encode_services, root_cause

ONCE = {"availableNow": True}


def event(source, message, **more):
    return json.dumps({"source_type": source, "timestamp": "2025-01-01T00:00:00Z", "message": message, **more})


EVENTS = [
    event("github_commits", json.dumps({"author": "a", "email": "e", "repository": "r"})),
    event("github_actions", json.dumps({"event": "push", "name": "n", "status": "done"})),
    event("public_cloud", json.dumps({"event_name": "x", "username": "u"})),
    event("app_container_metrics", json.dumps({"name": "m", "value": 1.5})),
    json.dumps({"source_type": "app_container_metrics", "name": "top", "value": 2, "device": "eth0"}),
    event("app_container_log", json.dumps({"level": "INFO", "message": "it is UNREACHABLE"})),
    event("fastapi_status", json.dumps({"name": "h", "value": 0.5, "status_code": 503})),
    event("nginx_access", '{"status":500,"request_time":0.004,"remote_addr":"1.1.1.1"}'),
    event("nginx_access", '{"status": 500}'),
    event("nginx_error", "t [error] 7#7: *1 failed (111: refused)"),
    event("nginx_error", "no match here"),
    event("other", "{}"),
    "not json",
    "{}",
    None,
]


def source(spark):
    return spark.createDataFrame([(e,) for e in EVENTS], "json_str string")


def test_routing(spark):
    envelope = parse_envelope(source(spark))
    routed = route_structured(envelope)
    assert routed.columns == schemas.STRUCTURED_COLUMNS and len(routed.columns) == 36
    found = routed.collect()
    assert len(found) == 11
    by = lambda c: sorted(str(getattr(r, c)) for r in found if getattr(r, c) is not None)
    assert by("name") == ["m", "top"] and by("value") == ["1.5", "2"] and by("device") == ["eth0"]
    assert by("error_level") == ["", "error"] and by("error_detail") == ["", "*1 failed (111: refused)"]
    assert by("response_status") == ["500", "500"] and by("container_value") == ["0.5"]
    united = union_sources(*[source_rows(envelope, s) for s in schemas.SOURCES])
    order = schemas.STRUCTURED_COLUMNS
    assert rows(united, *order) == rows(routed, *order)


def test_the_first_of_repeated_keys_counts(spark):
    inner = '{"level":"INFO","level":"ERROR","message":"a","logger":{"x":1}}'
    text = json.dumps({"source_type": "app_container_log", "timestamp": "t", "message": inner})
    twice = text[:-1] + ', "timestamp": "u"}'
    envelope = parse_envelope(spark.createDataFrame([(twice,)], "json_str string"))
    assert envelope.first().timestamp == "t"
    routed = route_structured(envelope).first()
    assert (routed.log_level, routed.log_message, routed.logger_name) == ("INFO", "a", '{"x":1}')
    assert route_for_scoring(envelope).first().log_level == "ERROR"  # the evaluation takes the last


@pytest.mark.parametrize("key", ["level", "le\\u0076el"])
def test_a_key_spelt_with_escapes_is_the_same_key(spark, key):
    inner = f'{{"{key}":"FIRST","level":"SECOND","message":"has \\"level\\" inside"}}'
    df = spark.createDataFrame([(event("app_container_log", inner),)], "json_str string")
    found = route_structured(parse_envelope(df)).first()
    assert (found.log_level, found.log_message) == ("FIRST", 'has "level" inside')


def test_a_true_is_one_and_its_name_is_none(spark):
    data = [event("nginx_access", inner) for inner in ('{"status": true}', '{"status": "true"}', '{"status": false}', '{"status":"7"}')]
    found = route_for_scoring(parse_envelope(spark.createDataFrame([(d,) for d in data], "json_str string")))
    assert [r.response_status for r in found.collect()] == [1.0, 0.0, 0.0, 7.0]


def test_routing_reads_once(spark, tmp_path):
    source(spark).write.parquet(str(tmp_path / "e"))
    routed = route_structured(parse_envelope(spark.read.parquet(str(tmp_path / "e"))))
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_labels(spark):
    envelope = parse_envelope(source(spark))
    assert rule_labels(envelope).agg(F.sum("label")).first()[0] == 2
    assert rule_labels(envelope, FULL_RULES).agg(F.sum("label")).first()[0] == 4


def test_scoring_defaults(spark):
    envelope = parse_envelope(source(spark))
    found = route_for_scoring(envelope)
    assert found.columns == schemas.FEATURE_COLUMNS and found.count() == len(EVENTS)
    beat = found.where("source_type = 'fastapi_status'").first()
    assert (beat.value, beat.container_value, beat.error_detail) == (0.5, 0.0, "unknown")
    shared = route_for_scoring(envelope, compat=False).where("source_type = 'fastapi_status'").first()
    assert (shared.value, shared.container_value) == (0.0, 0.5)


def test_metrics(spark):
    data = [
        ("node_load1", "absolute", (1.0,), (2.0,), {"device": "eth0", "cpu": "1"}),
        ("node_load5", "absolute", (None,), (3.0,), {"cpu": "1", "mode": "idle"}),
        ("node_load15", "absolute", None, None, None),
        ("other", "absolute", (1.0,), None, None),
    ]
    df = spark.createDataFrame(data, schemas.METRIC_SAMPLE)
    found = rows(flatten_metrics(keep_metrics(df)), "name", "value", "device", "cpu", "mode")
    assert found == [
        ("node_load1", 1.0, "eth0", None, None),
        ("node_load15", None, None, None, None),
        ("node_load5", 3.0, None, "1", "idle"),
    ]


def test_health(spark):
    data = [(200, None), (399, None), (404, None), (None, "connection"), (None, "timeout"), (None, "bang")]
    found = classify_health(spark.createDataFrame(data, "code int, error_kind string")).collect()
    assert [(r.status, r.status_code, r.value) for r in found] == [
        ("running", 200, 1.0),
        ("running", 399, 1.0),
        ("http_error", 404, 0.5),
        ("connection_failed", 0, 0.0),
        ("timeout", 408, 0.0),
        ("critical_failure", 500, 0.0),
    ]


def test_pages(spark):
    commits = json.dumps([{"commit": {"author": {"name": "n", "email": "e", "date": "d"}}}, {"commit": {}}])
    page = spark.createDataFrame([(commits,), ("[]",)], "body string")
    found = rows(flatten_commits(page, "o/r"))
    assert found == [("github_commit", "n", "e", "d", "o/r"), ("github_commit", None, None, None, "o/r")]
    runs = json.dumps({"workflow_runs": [{"name": "n", "path": "p", "actor": None}, {"actor": {"login": "l"}}]})
    found = flatten_runs(spark.createDataFrame([(runs,)], "body string"), "o/r")
    assert rows(found, "name", "pipeline_file", "actor") == [("n", "p", None), (None, None, "l")]


def test_files(spark, tmp_path):
    log = tmp_path / "feedback.jsonl"
    log.write_text('{"timestamp": "t", "mse": 1.5, "feedback_label": "true"}\nbad line\n\n{"mse": 2}\n')
    assert rows(sources.read_jsonl(spark, str(log), schemas.FEEDBACK), "mse") == [(1.5,), (2.0,)]
    assert sources.read_jsonl(spark, str(log), schemas.FEEDBACK).count() == 2
    names = ["z", "a", "m"]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"service_name": n}) + "\n" for n in names) + "{oops\n")
    found = sources.read_catalog(spark, str(tmp_path / "c.jsonl")).orderBy("ord")
    assert [r.service_name for r in found.collect()] == names
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "cpu.log").write_text("one\ntwo\n")
    (logs / "http.log").write_text("three")
    found = rows(sources.read_experiment_logs(spark, str(logs)))
    assert found == [("cpu", 0, "one"), ("cpu", 1, "two"), ("http", 0, "three")]


def test_a_long_log_is_split_and_keeps_its_order(spark, tmp_path):
    lines = {n: [f"{n} line {i} {'x' * (i % 50)}" for i in range(3000)] for n in ("one", "two")}
    for name, content in lines.items():
        (tmp_path / f"{name}.log").write_text("\n".join(content) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = sources.read_experiment_logs(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = {n: [r.value for r in read.where(F.col("experiment") == n).orderBy("ord").collect()] for n in lines}
        ords = sorted(r.ord for r in read.where("experiment = 'two'").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == lines and ords == list(range(3000))


def test_partitioned_table_prunes(spark, tmp_path):
    path = str(tmp_path / "s")
    sources.write_partitioned(route_structured(parse_envelope(source(spark))), path)
    one = sources.read_structured(spark, path).where("source_type = 'nginx_error'").select("error_level")
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_type" in plan and "ReadSchema: struct<error_level:string>" in plan
    rep = str(tmp_path / "r")
    sources.write_report(one, rep)
    assert spark.read.option("header", True).csv(rep).columns == ["error_level"]
    sem = semantic_rows(source(spark)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    sources.write_semantic(sem, str(tmp_path / "sem"))
    assert sources.read_semantic(spark, str(tmp_path / "sem")).count() == len(EVENTS)


def text_dir(tmp_path, lines, files=1, name="in"):
    folder = tmp_path / name
    folder.mkdir()
    for i in range(files):
        (folder / f"{i}.txt").write_text("\n".join(lines[i::files]) + "\n")
    return str(folder)


def test_stream_equals_batch(spark, tmp_path):
    lines = [e for e in EVENTS if e]
    stream = sources.read_events_stream(spark, "text", text_dir(tmp_path, lines))
    routed = route_structured(parse_envelope(stream))
    out = str(tmp_path / "out")
    sources.start_sink(routed, out, str(tmp_path / "cp"), ["source_type"], trigger=ONCE).awaitTermination()
    batch = route_structured(parse_envelope(source(spark)))
    order = schemas.STRUCTURED_COLUMNS
    assert rows(sources.read_structured(spark, out), *order) == rows(batch, *order)


def test_publish_and_tail(spark, tmp_path):
    tail = sources.read_log_dir_stream(spark, text_dir(tmp_path, ["[warn] a: b", "c"]), "nginx_error")
    folder = str(tmp_path / "topic")
    query = sources.write_events_stream(
        parse_envelope(tail).drop("json_str"), "text", str(tmp_path / "cp"), ONCE, path=folder
    )
    query.awaitTermination()
    found = spark.read.text(folder).select(F.get_json_object("value", "$.message").alias("m"))
    assert rows(found) == [("[warn] a: b",), ("c",)]


def test_collect_until_stops_and_resumes(spark, tmp_path):
    folder = text_dir(tmp_path, [f"line {i}" for i in range(60)], files=12)
    stream = sources.read_events_stream(spark, "text", folder, maxFilesPerTrigger="1")
    out, state = str(tmp_path / "out"), str(tmp_path / "cp")
    first = collect_until(stream, 20, out, state, poll=0.1, timeout=60)
    kept = spark.read.parquet(out)
    assert first >= 20 and kept.count() == kept.distinct().count() >= first
    rest = 60 - kept.count()
    collect_until(stream, 10_000, out, state, timeout=90, trigger=ONCE)
    kept = spark.read.parquet(out)
    assert rest >= 0 and kept.count() == kept.distinct().count() == 60


def test_collect_until_times_out(spark, tmp_path):
    stream = sources.read_events_stream(spark, "text", text_dir(tmp_path, ["a"]))
    started = time.monotonic()
    found = collect_until(stream, 100, str(tmp_path / "o"), str(tmp_path / "c"), timeout=6, poll=0.1)
    assert found <= 1 and time.monotonic() - started < 60


@pytest.mark.parametrize("cuts", ["late", "mixed"])
def test_alert_transitions(spark, tmp_path, cuts):
    """The changes do not depend on how the rows are dealt to batches."""
    t0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
    on = [0, 1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 0]
    folder = str(tmp_path / "in")
    data = [("s", t0 + timedelta(seconds=5 * i), float(v)) for i, v in enumerate(on)]
    end = [("end", t0 + timedelta(hours=1), 0.0)]
    if cuts == "late":  # late copies change nothing
        parts = (data[:5], data[5:] + data[1:3], end)
    else:
        parts = (data[7:9] + data[:2], data[4:7], data[9:] + data[2:4], end)
    for part in parts:
        spark.createDataFrame(part, "s string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("s string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(folder)
    changes = alert_transitions(stream, F.col("v") > 0, "s", cooldown_checks=3, late="2 minutes")
    out = str(tmp_path / "out")
    sources.start_sink(changes, out, str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    got = [(r.ts.second, r.state) for r in spark.read.parquet(out).orderBy("ts", "state").collect()]
    assert got == [
        (5, "pending"),
        (10, "firing"),
        (20, "inactive"),
        (30, "pending"),
        (30, "recovered"),
        (35, "firing"),
        (40, "inactive"),
        (50, "recovered"),
    ]


def test_streams_read_a_folder_of_parts(spark, tmp_path):
    """A table that is a folder gives the stream queries what a single file gives."""
    from opswatch.plans import streams

    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_structured", "stream_sessions"):
        assert rows(streams.QUERIES[name](spark, str(tmp_path))) == rows(streams.QUERIES[name](spark, one))


@pytest.mark.parametrize("keys", [[], ["host", "n"]])
@pytest.mark.parametrize("batches", [1, 4])
def test_anomaly_sessions(spark, tmp_path, keys, batches):
    """Sessions of a stream are the episodes of the table, in however many batches it comes."""
    t0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rng = random.Random(8)
    at, data = 0.0, []
    for _ in range(120):
        at += rng.choice([0.0, 2.5, 4.0, 9.0, 10.0, 10.5, 25.0])
        data.append((rng.choice("ab"), rng.choice([1, None]), t0 + timedelta(seconds=at)))
    schema, folder = "host string, n int, ts timestamp", str(tmp_path / "in")
    size = -(-len(data) // batches)
    end = [[("end", 0, t0 + timedelta(days=d))] for d in (1, 2)]
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), *end]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    query = sources.start_sink(anomaly_sessions(stream, keys, late="1 second"), out, str(tmp_path / "cp"), trigger=ONCE)
    query.awaitTermination()
    found = spark.read.parquet(out).where(F.col("first_anomaly") < F.lit("2025-01-01 12:00:00"))
    assert rows(found) == rows(anomaly_episodes(spark.createDataFrame(data, schema), keys))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # the open session of the end


def test_root_cause_stream(spark, tmp_path):
    names = ["nginx", "fastapi-demo", "redis"]
    catalog = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "service_name string, ord long")
    services = encode_services(catalog)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [
        {"semantic_text": "fastapi-demo is down", "feedback_label": "TRUE"},
        {"semantic_text": "redis", "feedback_label": "true"},
        {"semantic_text": "nginx", "feedback_label": "false"},
        {"semantic_text": "", "feedback_label": "true"},
    ]
    (folder / "f.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    stream = sources.read_jsonl_stream(spark, str(folder), schemas.FEEDBACK)
    out = str(tmp_path / "out")
    sources.start_sink(root_cause(stream, services), out, str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    found = {r.semantic_text: r.candidates for r in spark.read.parquet(out).collect()}
    assert {t: c[0]["entity"] for t, c in found.items()} == {
        "fastapi-demo is down": "fastapi-demo",
        "redis": "redis",
    }
    assert found["redis"][0]["confidence"] == pytest.approx(1.0, abs=1e-6) and len(found["redis"]) == 3
