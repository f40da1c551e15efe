import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opswatch import functions as fn
from opswatch.functions import semantic


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    df = column(spark, values, kind).orderBy("i")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def event(message, **more):
    return json.dumps({"source_type": "s", "message": message, **more})


AGREED = [
    (event('{"a": 1, "request_time": 2, "last_updated": 3, "sentiment": 4, "b": "x y"}'), "a=1 b=x y"),
    (event("plain text"), "plain text"),
    (event('{"Created_AT": 1, "k": null}'), "k=None"),
    (event("{}"), ""),
    (event(None), "None"),
    (event({"k": 5, "date": 1}), "k=5"),
    ('{"name": "n", "value": 0.5, "timestamp": "t"}', "name=n value=0.5"),
    ("{}", ""),
    ("not json", "[INVALID_JSON]"),
    (None, "[INVALID_JSON]"),
    (event('{"v": 1e3}'), "v=1000.0"),
]
EXACT_ONLY = [
    (event("[1, 2]"), "[1, 2]"),
    (event('{"b": true, "n": {"k": 1}}'), "b=True n={'k': 1}"),
    (event('{"a": 1, "a": 2}'), "a=2"),
    ("[1, 2]", "[1, 2]"),
    ("5", "5"),
    (event(5), "5"),
]


def test_semantic_text_native(spark):
    got = apply(spark, [p for p, _ in AGREED], fn.semantic_text)
    assert got == [t for _, t in AGREED]


def test_semantic_text_exact(spark):
    cases = AGREED + EXACT_ONLY
    got = apply(spark, [p for p, _ in cases], lambda c: fn.semantic_text(c, "exact"))
    assert got == [t for _, t in cases]


UNLIKE = [
    "{'a': 1}", '{"a": 1} x', '{"a": 1}}', '{"a": 1},{"b": 2}', '{"a": 1.50}', '{"a": 1e3}', '{"a": -0}', '{"a": NaN}', '{"a": 01}',
    event("1.50"), event("true"), event("null"), event('"quoted"'), event("[1]"), event(" 7 "), event("-"), event("text: true"),
    event("{'a': 1}"), event('{"a": 1} more'), event('{"a": {"b": [true]}}'), event('{"a": "x}y"}'), event('{"a": 1, "a": 2}'), event(""),
    event('{"a": "\\u0041"}'), event("plain text"), event('{"time": 1, "k": "v", "n": 3, "z": null}'), '{"a": "b", "n": 12}', "", None, "{}",
]


def test_exact_text_of_rows_that_stay_in_the_jvm_and_of_others(spark):
    cases = [p for p, _ in AGREED + EXACT_ONLY] + UNLIKE
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, v string")
    got = {r.i: r.semantic_text for r in fn.with_semantic_text(df, "v", mode="exact").collect()}
    assert [got[i] for i in range(len(cases))] == [semantic.render(p) for p in cases]
    obj = df.withColumn("o", semantic.json_object(F.col("v"))).withColumn("m", semantic.message_of(F.col("o")))
    obj = obj.withColumn("n", semantic.json_object(F.col("m")))
    alike = obj.select("v", semantic.prints_alike(*map(F.col, "vomn")).alias("a")).where("a").select("v")
    stay = {r.v for r in alike.collect()}
    assert {UNLIKE[-6], UNLIKE[-5], UNLIKE[-4]} <= stay


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.dictionaries(
            st.text(alphabet="abt'{}: " + '"', max_size=4),
            st.recursive(
                st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(alphabet="ab'{}[]:,-0 é" + '"', max_size=6)),
                lambda inner: st.one_of(st.lists(inner, max_size=2), st.dictionaries(st.text(max_size=2), inner, max_size=2)),
                max_leaves=3,
            ),
            max_size=3,
        ),
        min_size=1, max_size=30,
    )
)
def test_exact_text_of_any_object(spark, objects):
    cases = [json.dumps(o) for o in objects] + [event(json.dumps(o)) for o in objects]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, v string")
    got = {r.i: r.semantic_text for r in fn.with_semantic_text(df, "v", mode="exact").collect()}
    assert [got[i] for i in range(len(cases))] == [semantic.render(p) for p in cases]


def test_semantic_text_mode(spark):
    with pytest.raises(ValueError):
        fn.semantic_text(F.col("v"), "other")


plain = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=8)
flat = st.dictionaries(plain, st.one_of(plain, st.integers(-(2**40), 2**40), st.none()), max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(flat, min_size=1, max_size=20))
def test_modes_agree_on_flat_objects(spark, objects):
    payloads = [event(json.dumps(o)) for o in objects]
    assert apply(spark, payloads, fn.semantic_text) == [semantic.render(p) for p in payloads]


def test_to_number(spark):
    values = ["1", " 2.5 ", "1d", "2f", "3D", "", " ", None, "abc", "NaN", "1e3", "-4", ".5", "inf"]
    got = apply(spark, values, fn.to_number)
    want = [1.0, 2.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, -4.0, 0.5, float("inf")]
    assert got == want


def test_tier_and_decision(spark):
    ratios = [0.5, 1.0, 1.5, 2.0, 2.1, float("nan"), None]
    got = apply(spark, ratios, fn.tier, "double")
    assert got == ["normal", "normal", "low_anomaly", "low_anomaly", "high_anomaly", "normal", "error"]
    decided = apply(spark, ratios, lambda c: fn.decide(c, F.lit(1.0), 2.0), "double")
    assert decided == [0, 0, 0, 0, 1, 0, 0]
    assert apply(spark, [1.0], lambda c: fn.anomaly_ratio(c, F.lit(0.0)), "double") == [None]


def test_text_functions(spark):
    texts = ["see http://a.b:80/x", "name=web-1_blue http:/", "none", None]
    assert apply(spark, texts, fn.url_host) == ["a.b", None, None, None]
    assert apply(spark, texts, fn.named_service) == [None, "web-1", None, None]
    assert apply(spark, ["  a  b\tc ", "", " "], fn.log_tokens) == [["a", "b", "c"], [], []]
    assert apply(spark, ["ERRor"], lambda c: fn.contains_ci(c, "Error")) == [True]


def test_json_functions(spark):
    docs = ['{"b": 1, "a": {"c": 2}}', "[1]", "bad", None]
    assert apply(spark, docs, fn.is_json_object) == [True, False, False, False]
    entries = apply(spark, docs[:1], fn.json_entries)[0]
    assert [(e["key"], e["value"]) for e in entries] == [("b", "1"), ("a", '{"c":2}')]


def test_parse_ts(spark):
    texts = ["2025-01-01T00:00:01Z", "2025-01-01T02:00:01+02:00", "2025-01-01T00:00:01", "x", None]
    got = apply(spark, texts, lambda c: fn.micros(fn.parse_ts(c)))
    assert got[0] == got[1] == got[2] and got[3:] == [None, None]


def test_vectors(spark):
    pair = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in pair.select(fn.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.96, 0.0])


def test_a_text_is_encoded_once(spark):
    """Filters derived from the vectors, as in ``posexplode``, do not encode again; nor do filters on what follows from them."""
    from opswatch.operators.autoencoder import initial
    from opswatch.operators.encode import encode
    from opswatch.operators.scoring import score_vectors

    df = spark.createDataFrame([(1, "abc"), (2, "defg"), (3, None)], "id long, text string")
    vectors = encode(df, "text", dim=8)
    one = vectors.select("id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    model = initial(8, 2)
    model.threshold = 1e-9
    two = score_vectors(vectors, model).where("prediction like '%anomaly'").select("id", "mse")
    for found, stages in ((one, 1), (two, 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == stages
    assert {r["id"] for r in one.collect()} == {1, 2} == {r["id"] for r in two.collect()}


def test_encoding_cuts_batches():
    from opswatch.operators import encode as e

    lengths = np.array([3, 0, e._CHARACTERS * 2, 5] + [1] * (2 * e._TEXTS))
    cuts = list(e._slices(lengths))
    assert [i for c in cuts for i in range(c.start, c.stop)] == list(range(len(lengths)))
    assert all(c.stop - c.start <= e._TEXTS for c in cuts)
    assert all(c.stop - c.start == 1 or lengths[c].sum() <= e._CHARACTERS for c in cuts)
    assert list(e._slices(np.zeros(0, np.int64))) == []


def test_plugged_in_encoder_gets_parts_of_a_batch(spark):
    """Its vectors hold the number of texts that it was given; some texts have none, some are of another length."""
    from opswatch.operators.encode import encode

    class Counting:
        def encode(self, texts):
            if len(texts) > 1 and "bad" in texts:
                raise ValueError("bad")
            return [[] if t in (None, "bad") else [float(len(texts)), 1.0][: 1 if t == "short" else 2] for t in texts]

    texts = ["short", None, *["x"] * 3000, "bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = [r["embedding"] for r in encode(df, "text", encoder=lambda: Counting()).orderBy("id").collect()]
    assert [len(v) for v in found] == [1, 0, *[2] * 3000, 0]
    assert max(v[0] for v in found if v) <= 1024
    assert found[0] == [1024.0] and found[1500] == [1024.0, 1.0]
