import json
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from opswatch.functions import record_json
from opswatch.operators.evaluation import (
    average_detection,
    binary_metrics,
    parse_experiment_log,
    rca_gain,
    stage_counts,
    time_to_detect,
)
from opswatch.operators.labels import (
    apply_feedback,
    confirmed,
    matches_keywords,
    new_feedback,
    unmatched_labels,
    valid_anomalies,
)
from opswatch.operators.rootcause import (
    attach_entity,
    cosine_topk,
    entity_text,
    extract_service,
    first_named,
    rca_pairs,
    with_candidates,
)

CATALOG = "service_name string, domain string, system string, dependencies array<string>, ord long"


def catalog(spark, names):
    return spark.createDataFrame([(n, "d", None, ["x", "y"], i) for i, n in enumerate(names)], CATALOG)


def test_entity_text(spark):
    df = spark.createDataFrame([("s", None, "m", ["a", "b"], 1), ("t", "d", "m", None, 2)], CATALOG)
    assert rows(entity_text(df), "entity_text") == [("s  m a b",), ("t d m ",)]


TEXTS = [
    ("upstream http://10.0.0.5:8000/x nginx", "10.0.0.5"),
    ("call to service-10 failed", "service-1"),
    ("nginx and service-2", "service-2"),
    ("name=web_main status", "web"),
    ("nothing", None),
    (None, None),
]


@pytest.mark.parametrize("inline", [0, 500])
def test_extract_service(spark, inline):
    names = catalog(spark, ["service-2", "service-1", "service-10", "nginx", None])
    df = spark.createDataFrame([(t,) for t, _ in TEXTS] * 2, "semantic_text string")
    found = extract_service(df, names, max_inline=inline)
    assert sorted(rows(found), key=str) == sorted(TEXTS * 2, key=str)
    first = extract_service(df, names, catalog_first=True, max_inline=inline)
    assert ("upstream http://10.0.0.5:8000/x nginx", "nginx") in rows(first)
    none = extract_service(df, names.where("ord < 0"), max_inline=inline)
    assert ("nginx and service-2", None) in rows(none)


@pytest.mark.parametrize("inline", [0, 500])
@pytest.mark.parametrize("names, text, want", [
    (["", "svc-a"], "hello svc-a", ""), (["svc-a", ""], "hello svc-a", "svc-a"), (["svc-a", ""], "hello", ""),
    (["svc-a"], None, None), (["b", "ab", "é"], "xé ab", "b"),
])
def test_both_forms_name_the_same(spark, inline, names, text, want):
    df = spark.createDataFrame([(text,)], "semantic_text string")
    found = first_named(df, catalog(spark, names), "semantic_text", "named", max_inline=inline, block_names=1)
    assert found.first().named == want


@pytest.mark.parametrize("limit", [0, 1000])
def test_topk_on_odd_vectors(spark, limit):
    """Null and wrong vectors have no answer; rows that share an id are answered each."""
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, 1.0])], "id long, embedding array<double>")
    entities = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [1.0, 0.0])], "service_name string, ord long, vector array<double>")
    found = cosine_topk(queries, entities, 2, max_values=limit, block=2)
    assert rows(found, "id", "rank", "entity") == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "c"), (4, 1, "a"), (4, 2, "b")]
    listed = with_candidates(queries, entities, 2, max_values=limit).select("id", "candidates.entity")
    assert sorted((r[0], tuple(r[1] or ())) for r in listed.collect()) == [(1, ("a", "c")), (1, ("b", "a")), (2, ()), (3, ()), (4, ("a", "b"))]


def test_pairs_use_the_last_entry_of_a_name(spark):
    df = spark.createDataFrame(
        [("nginx", "old", "s", [], 1), ("nginx", "new", "s", ["a"], 2)], CATALOG
    )
    feedback = spark.createDataFrame(
        [("nginx down", "true"), ("nginx down", "false"), ("other", "true")],
        "semantic_text string, feedback_label string",
    )
    assert rows(rca_pairs(feedback, df), "service", "entity_text") == [("nginx", "nginx new s a")]
    assert attach_entity(spark.createDataFrame([("zzz",)], "service string"), df).count() == 0


def test_topk_forms_agree(spark):
    rng = np.random.default_rng(0)
    q, e = rng.normal(size=(70, 8)), rng.normal(size=(45, 8))
    e[7] = e[3]  # a tie, broken by order
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, embedding array<double>")
    entities = spark.createDataFrame(
        [(f"e{i}", i, v.tolist()) for i, v in enumerate(e)], "service_name string, ord long, vector array<double>"
    )
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T
    best = np.argsort(-cos, axis=1, kind="stable")[:, :3]
    want = [(i, r + 1, f"e{c}", pytest.approx(cos[i, c])) for i in range(70) for r, c in enumerate(best[i])]
    assert rows(cosine_topk(queries, entities)) == want
    assert rows(cosine_topk(queries, entities, max_values=0, block=10)) == want


def test_feedback_takes_the_first_match(spark):
    anomalies = spark.createDataFrame(
        [("t1", "b", 2), ("t1", "a", 1), ("t2", "c", 3)], "timestamp string, semantic_text string, ord long"
    )
    labels = spark.createDataFrame(
        [("t1", "true", "nginx"), ("t1", "false", ""), ("t9", "true", None)],
        "timestamp string, feedback_label string, root_cause string",
    )
    found = apply_feedback(anomalies, labels, "ord")
    want = [("t1", "a", "false", None), ("t1", "a", "true", "nginx")]
    assert rows(found, "timestamp", "semantic_text", "feedback_label", "root_cause") == want
    assert rows(unmatched_labels(anomalies, labels), "timestamp") == [("t9",)]
    assert apply_feedback(anomalies, labels.drop("root_cause"), "ord").count() == 2


def test_keywords(spark):
    data = [
        ("high_anomaly", "CPU burst", "m"),
        ("low_anomaly", "", "cpu"),
        ("low_anomaly", None, None),
        ("normal", "cpu", "m"),
        ("high_anomaly", "disk", "cpu"),
    ]
    df = spark.createDataFrame(data, "prediction string, semantic_text string, message string")
    assert valid_anomalies(df).count() == 4
    assert rows(valid_anomalies(df, ["cpu"]), "semantic_text", "message") == [("", "cpu"), ("CPU burst", "m")]
    assert df.where(matches_keywords(df, ["low_anom"])).count() == 1


def test_confirmed_and_new_lines(spark):
    df = spark.createDataFrame([("true", "a"), ("TRUE", "b"), ("true", ""), ("false", "c")], "feedback_label string, semantic_text string")
    assert confirmed(df).count() == 2 and confirmed(df, strict=False).count() == 2
    lines = spark.createDataFrame([("x",), ("x",), (" ",), ("y",)], "value string")
    assert rows(new_feedback(lines, None)) == [("x",), ("y",)]
    assert rows(new_feedback(lines, lines.where("value = 'x'"))) == [("y",)]


def test_metrics(spark):
    data = [("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 0, 0)]
    df = spark.createDataFrame(data, "g string, y int, p int")
    assert rows(binary_metrics(df, "y", "p", ["g"])) == [("a", 0.5, 0.5, 0.5), ("b", 0.0, 0.0, 0.0)]
    gains = spark.createDataFrame([(0.5, 0.6), (0.2, 0.1), (0.0, 1.0)], "b double, a double")
    assert rca_gain(gains, "b", "a").first()["avg_gain"] == pytest.approx((0.2 - 0.5) / 2)
    assert rows(stage_counts(df, {"ones": F.col("y") == 1})) == [(4, 2)]


LOG = """inject_start 2025-01-01T00:00:00+00:00
PROMETHEUS_MONITOR prometheus_detection_detected 2025-01-01T00:00:12+00:00
AI_MONITOR ai_detection_detected 2025-01-01T00:00:06+00:00
noise

AI_MONITOR ai_recovered 2025-01-01T00:00:30+00:00
PROMETHEUS_MONITOR prometheus_recovered 2025-01-01T00:00:41+00:00"""


def lines(spark, **logs):
    data = [(name, i, line) for name, text in logs.items() for i, line in enumerate(text.split("\n"))]
    return parse_experiment_log(spark.createDataFrame(data, "experiment string, ord int, value string"))


def test_detection_times(spark):
    repeated = LOG + "\nAI_MONITOR ai_recovered 2025-01-01T00:00:50Z"
    partial = "inject_start 2025-01-01T00:00:00Z\nAI_MONITOR ai_detection_detected 2025-01-01T00:00:06Z"
    times = time_to_detect(lines(spark, full=LOG, again=repeated, part=partial, none="AI_MONITOR a b c"))
    found = {(r.experiment, r.system.split()[0]): tuple(r)[2:] for r in times.collect()}
    assert found == {
        ("full", "Traditional"): (12.0, 29.0, 41.0),
        ("full", "Machine"): (6.0, 24.0, 30.0),
        ("again", "Traditional"): (12.0, 29.0, 41.0),
        ("again", "Machine"): (6.0, 44.0, 50.0),
        ("part", "Traditional"): (None, None, None),
        ("part", "Machine"): (None, None, None),
    }
    average = {r.system.split()[0]: tuple(r)[1:] for r in average_detection(times).collect()}
    assert average == {"Traditional": (12.0, 29.0, 41.0), "Machine": (6.0, 34.0, 40.0)}
    empty = average_detection(times.where("experiment = 'part'"))
    assert {tuple(r)[1:] for r in empty.collect()} == {(0.0, 0.0, 0.0)}


def test_record_json(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert json.loads(df.select(record_json(df)).first()[0]) == {"a": 1, "b": "x"}


def test_skewed_text_keeps_every_row(spark):
    random.seed(1)
    texts = ["call nginx now"] * 200 + [f"service-{i}" for i in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "semantic_text string").repartition(6)
    names = catalog(spark, [f"service-{i}" for i in range(60)] + ["nginx"])
    for inline in (0, 500):
        found = extract_service(df, names, max_inline=inline)
        assert found.count() == 300 and found.where("service = 'nginx'").count() == 200
