"""Percentiles, scaler, vocabulary, networks and scores against numpy and plain loops."""

import json
from dataclasses import replace

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from opswatch import schemas
from opswatch.operators import autoencoder as ae
from opswatch.operators.encode import encode
from opswatch.operators.envelope import parse_envelope, route_structured
from opswatch.operators.features import (
    fit_features,
    fit_onehot,
    fit_scaler,
    load_features,
    save_features,
    select_features,
    valid_embeddings,
)
from opswatch.session import cut_lineage
from opswatch.operators.projection import fit_projection, load_projection, ranking_loss, save_projection
from opswatch.operators.quantiles import exact_percentile
from opswatch.operators.scoring import SemanticBundle, StructuredBundle, evaluate, score_events, score_vectors


def vectors(spark, n=300, dim=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    return df, x.astype(np.float64)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.975, 1.0])
def test_percentile_of_many_values(spark, q):
    rng = np.random.default_rng(7)
    groups = {
        "plain": rng.normal(size=900),
        "ties": np.where(rng.random(700) < 0.6, 3.0, rng.normal(size=700)),
        "one": np.array([4.0]),
    }
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("plain", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    want = {g: np.percentile(v, 100 * q) for g, v in groups.items()}
    for limit in (40, 10_000):
        found = exact_percentile(df, "v", q, ("g",), max_values=limit, accuracy=200)
        assert {r.g: r.percentile for r in found.collect()} == pytest.approx(want)
    overall = exact_percentile(df, "v", q, max_values=40, accuracy=200).first()[0]
    assert overall == pytest.approx(np.percentile(np.concatenate(list(groups.values())), 100 * q))


def test_scaler(spark):
    df, x = vectors(spark)
    df = df.withColumn("embedding", F.concat("embedding", F.array(F.lit(5.0).cast("float"))))
    row = fit_scaler(df).first()
    assert row["mean"] == pytest.approx([*x.mean(0), 5.0])
    assert row["scale"] == pytest.approx([*x.std(0), 1.0])
    assert fit_scaler(df.where("id < 0")).count() == 0
    assert valid_embeddings(df, 6).count() == 0 and valid_embeddings(df, 7).count() == 300


def test_vocabulary_numbered_across_partitions(spark):
    data = [(f"v{i % 57:03}", "hot" if i % 3 else f"w{i}") for i in range(400)]
    df = spark.createDataFrame(data, "a string, b string").repartition(6)
    want = [(c, v, i) for c, values in zip("ab", zip(*data)) for i, v in enumerate(sorted(set(values)))]
    assert rows(fit_onehot(df, ["a", "b"])) == sorted(want)
    assert rows(fit_onehot(df, ["a", "b"], max_plain_values=5)) == sorted(want)


def test_feature_rows(spark, tmp_path):
    data = [("1", "x"), ("bad", None), ("3", "y"), (None, "x")]
    df = spark.createDataFrame(data, "n string, c string")
    model = fit_features(df, ["n", "missing"], ["c", "absent"])
    assert model.labels == [["unknown", "x", "y"], ["unknown"]] and model.width == 6
    n = np.array([1.0, 0.0, 3.0, 0.0])
    save_features(model, spark, str(tmp_path / "f"))
    again = load_features(spark, str(tmp_path / "f"))
    unseen = df.unionByName(spark.createDataFrame([("0", "new")], "n string, c string"))
    found = again.transform(unseen).collect()
    assert [r.numbers for r in found[:4]] == [pytest.approx([v, 0.0]) for v in (n - n.mean()) / n.std()]
    assert [r.hot for r in found] == [[3, 5], [2, 5], [4, 5], [3, 5], [5]]
    # the tie for the second place goes to the earlier value
    few = fit_features(df, ["n"], ["c"], head=2)
    assert few.labels == [["unknown", "x"]] and few.head_positions == [0, 1, 2] and few.width == 4
    assert [tuple(r) for r in few.tail.collect()] == [(0, "y", 3)]
    assert few.transform(unseen).collect()[2].rare == [(0, "y")]


def test_missing_features_get_defaults(spark):
    row = select_features(spark.createDataFrame([("7",)], "value string")).first()
    assert row["value"] == 7.0 and row["request_time"] == 0.0 and row["user_agent"] == "unknown"
    assert len(row) == len(schemas.FEATURE_COLUMNS) == 29


def test_gradient_is_the_slope(spark):
    model = ae.initial(5, 4, seed=1)
    x = np.random.default_rng(2).normal(size=(7, 5))
    mask = ae.dropout_mask(np.arange(7), 3, 4, 0.2)
    _, gradient = model.gradient_sums(x, mask)
    flat = model.flat()
    for i in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (
            model.with_flat(up).gradient_sums(x, mask)[0]
            - model.with_flat(down).gradient_sums(x, mask)[0]
        ) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-6)


def test_sparse_rows_equal_dense_rows():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    numbers = rng.normal(size=(9, 2))
    hot = [sorted(rng.choice(np.arange(2, 12), size=k, replace=False)) for k in (3, 0, 1, 4, 2, 0, 5, 1, 3)]
    lists = pa.array(numbers.tolist()), pa.array([[int(i) for i in r] for r in hot], pa.list_(pa.int32()))
    dense, sparse = ae.dense_features(*lists, 12), ae.sparse_features(*lists)
    model = ae.initial(12, 4, seed=1)
    mask = ae.dropout_mask(np.arange(9), 3, 4, 0.2)
    assert model.errors(sparse) == pytest.approx(model.errors(dense))
    for m in (None, mask):
        (a, g), (b, h) = model.gradient_sums(dense, m), model.gradient_sums(sparse, m)
        assert a == pytest.approx(b) and g == pytest.approx(h)
    keep = np.arange(9) % 2 == 0
    assert model.errors(sparse.where(keep)) == pytest.approx(model.errors(dense[keep]))


def test_dropout_share():
    mask = ae.dropout_mask(np.arange(5000), 1, 20, 0.2)
    assert (mask == 0).mean() == pytest.approx(0.2, abs=0.01) and mask.mean() == pytest.approx(1, abs=0.01)


def test_fullbatch_ignores_partitioning(spark):
    df, _ = vectors(spark)
    one, first = ae.fit_autoencoder(df.coalesce(1), mode="fullbatch", id_col="id", hidden=3, epochs=4)
    many, second = ae.fit_autoencoder(df.repartition(40), mode="fullbatch", id_col="id", hidden=3, epochs=4)
    assert one.flat() == pytest.approx(many.flat(), abs=1e-9)
    assert one.threshold == pytest.approx(many.threshold)
    assert [h["val_loss"] for h in first] == pytest.approx([h["val_loss"] for h in second])


def test_equal_rows_are_dealt_apart(spark):
    """Without an id each row is its own: copies neither share a shard nor a side of the split."""
    df = spark.range(2000).select(F.when(F.col("id") % 10 < 7, F.array(*[F.lit(1.0)] * 4)).otherwise(F.array(*[F.col("id") * 0.5] * 4)).alias("x"))
    dealt = cut_lineage(ae.training_rows(df, [F.col("x")], None))
    assert abs(dealt.where("held_out").count() / 2000 - ae.VALIDATION_SHARE) < 0.04
    sizes = [r["count"] for r in dealt.repartition(4, "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 600


def test_one_shard_is_plain_minibatch_training(spark):
    df, x = vectors(spark)
    fitted, history = ae.fit_autoencoder(df, id_col="id", hidden=3, epochs=3, batch_size=64, dropout=0.0, shards=1)
    hashed = df.select("id", F.xxhash64("id").alias("h"))
    orders = [
        [r.id for r in hashed.orderBy(F.xxhash64("h", F.lit(e)), "h").collect()] for e in range(3)
    ]
    model = replace(ae.initial(6, 3), mean=x.mean(0), scale=x.std(0))
    adam, flat = ae.Adam(len(model.flat()), 1e-3), model.flat()
    for order in orders:
        for start in range(0, 300, 64):
            part = model.scaled(x[order[start : start + 64]])
            _, gradient = model.with_flat(flat).gradient_sums(part)
            flat = adam.step(flat, gradient / len(part))
    assert fitted.flat() == pytest.approx(flat, abs=1e-9)
    errors = fitted.errors(fitted.scaled(x))
    assert fitted.threshold == pytest.approx(np.percentile(errors, 97.5))
    assert history[0]["loss"] > history[-1]["loss"]


def test_synchronous_steps_do_not_depend_on_the_tasks(spark):
    df, x = vectors(spark, n=240, dim=4)
    settings = {"mode": "synchronous", "id_col": "id", "hidden": 3, "epochs": 2, "batch_size": 60, "lr": 0.05, "dropout": 0.2}
    found = [ae.fit_autoencoder(df.repartition(tasks), **settings) for tasks in (1, 8, 64)]
    model, history = found[0]
    for other, losses in found[1:]:
        assert other.flat() == pytest.approx(model.flat(), rel=1e-9, abs=1e-12)
        assert [h["loss"] for h in losses] == pytest.approx([h["loss"] for h in history])
    # the same steps in a plain loop
    keyed = ae.training_rows(df, [F.col("embedding").alias("x")], "id")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(16))
    dealt = {r["id"]: (r["p"], r["x"]) for r in keyed.select("id", "x", part.alias("p")).collect()}
    net = replace(ae.initial(4, 3), mean=x.mean(0), scale=x.std(0))
    adam = ae.Adam(len(net.flat()), 0.05)
    for epoch in range(2):
        order = np.argsort(ae.start_numbers(np.arange(16), 1, 4, epoch)[:, 0], kind="stable")
        for batch in order.reshape(4, 4).tolist():
            ids = [i for i, (p, _) in dealt.items() if p in batch]
            rows_of = net.scaled(np.array([dealt[i][1] for i in ids]))
            mask = ae.dropout_mask(np.array(ids), epoch, 3, 0.2)
            gradient = net.gradient_sums(rows_of, mask)[1]
            net = net.with_flat(adam.step(net.flat(), gradient / len(ids)))
    assert model.flat() == pytest.approx(net.flat(), rel=1e-6, abs=1e-9)


def test_shards_follow_the_rows(spark):
    df, _ = vectors(spark)
    fitted, _ = ae.fit_autoencoder(df, id_col="id", hidden=3, epochs=2, shards=5)
    again, _ = ae.fit_autoencoder(df.repartition(7), id_col="id", hidden=3, epochs=2, shards=5)
    assert fitted.flat() == pytest.approx(again.flat(), abs=1e-12)


def test_scores_and_state(spark, tmp_path):
    df, x = vectors(spark)
    model, _ = ae.fit_autoencoder(df, id_col="id", hidden=3, epochs=1)
    ae.save_model(model, spark, str(tmp_path / "m"))
    again = ae.load_model(spark, str(tmp_path / "m"))
    assert again.flat() == pytest.approx(model.flat()) and again.threshold == model.threshold
    broken = df.unionByName(spark.createDataFrame([(-1, []), (-2, None)], df.schema))
    found = {r.id: r for r in score_vectors(broken, again).collect()}
    assert [found[i].prediction for i in (-1, -2)] == ["error", "error"] and found[-1].error
    errors = model.errors(model.scaled(x))
    assert [found[i].mse for i in range(300)] == pytest.approx(errors, abs=1e-6)
    tiers = ["high_anomaly" if r > 2 else "low_anomaly" if r > 1 else "normal" for r in errors / model.threshold]
    assert [found[i].prediction for i in range(300)] == tiers


def test_fine_tune(spark):
    df, _ = vectors(spark)
    model, _ = ae.fit_autoencoder(df, id_col="id", hidden=3, epochs=1)
    few = df.where("id < 30").withColumn("feedback_label", F.when(F.col("id") < 10, "true").otherwise("false"))
    tuned = ae.fine_tune(model, few)
    before = np.mean([r.mse for r in score_vectors(few, model).collect()])
    after = np.mean([r.mse for r in score_vectors(few, tuned).collect()])
    assert after < before and (tuned.mean == model.mean).all()
    assert ae.fine_tune(model, few, label_filter="true").threshold != tuned.threshold
    assert ae.fine_tune(model, few.where("id < 0")) is None


def failing_encoder():
    class Failing:
        def encode(self, texts):
            if any(t == "boom" for t in texts):
                raise RuntimeError("boom")
            return [[len(t), 1.0] for t in texts]

    return Failing


def test_plugged_encoder(spark):
    df = spark.createDataFrame([("ab",), ("boom",), ("c",), (None,)], "semantic_text string")
    found = {r.semantic_text: r.embedding for r in encode(df, encoder=failing_encoder()).collect()}
    assert found == {"ab": [2.0, 1.0], "boom": [], "c": [1.0, 1.0], None: []}


def test_default_encoder(spark):
    texts = ["error in pay", "ERROR in pay", "x" * 300_000 + "end", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, semantic_text string")
    v = [np.array(r.embedding) for r in encode(df).orderBy("i").collect()]
    assert (v[0] == v[1]).all() and len(v[4]) == 0 and not v[3].any()
    assert [np.linalg.norm(x) for x in v[:3]] == pytest.approx([1, 1, 1], abs=1e-6)


def log(i):
    level = "ERROR" if i % 10 == 0 else "INFO"
    return json.dumps(
        {
            "source_type": "app_container_log",
            "timestamp": "2025-01-01T00:00:00Z",
            "message": json.dumps({"level": level, "logger": "main", "message": f"{level} {i % 4}"}),
        }
    )


def counting_encoder():
    class Counting:
        """Vectors of four numbers; none for a null text, and one of another length for some."""

        def encode(self, texts):
            return [np.array([len(t), t.count("a"), t.count("b"), 1.0] + [0.0] * (t == "odd")) for t in texts]

    return Counting


def test_texts_train_as_their_vectors_do(spark, monkeypatch):
    data = [(i, None if i % 50 == 7 else "odd" if i % 50 == 9 else f"text {i * 7919 % 97} " + "ab" * (i % 5)) for i in range(700)]
    df = spark.createDataFrame([*data, (1000, "text 1"), (1000, "text 1"), (None, "text 2")], "id long, t string").repartition(5)
    written = []
    monkeypatch.setattr(ae, "cut_lineage", lambda rows: written.append(dict(rows.dtypes)) or cut_lineage(rows))
    for encoder, dim in ((None, 32), (counting_encoder(), 4)):
        settings = {"id_col": "id", "hidden": 3, "epochs": 3, "batch_size": 64, "shards": 3}
        want, losses = ae.fit_autoencoder(encode(df, "t", "embedding", encoder, dim), **settings)
        written.clear()
        found, history = ae.fit_autoencoder(df, text="t", encoder=encoder, encoded_dim=dim, **settings)
        assert len(written) > 1 and not any(t.startswith("array") for names in written for t in names.values())
        assert history == losses and found.threshold == pytest.approx(want.threshold, rel=1e-12)
        assert np.allclose(found.flat(), want.flat(), rtol=0, atol=1e-12) and np.allclose(found.mean, want.mean)
    settings = {"mode": "fullbatch", "id_col": "id", "hidden": 3, "epochs": 2}
    whole = ae.fit_autoencoder(df, text="t", encoded_dim=32, **settings)[1]
    assert whole == ae.fit_autoencoder(encode(df, "t", "embedding", None, 32), **settings)[1]


def test_detectors_end_to_end(spark):
    source = spark.createDataFrame([(log(i), int(i % 10 == 0)) for i in range(200)], "json_str string, label int")
    routed = route_structured(parse_envelope(source))
    features = fit_features(routed)
    structured, _ = ae.fit_autoencoder(routed, features=features, mode="fullbatch", epochs=2)
    texts = encode(source.withColumnRenamed("json_str", "semantic_text"), dim=32)
    semantic, _ = ae.fit_autoencoder(texts, epochs=2, hidden=4)
    found = evaluate(source, SemanticBundle(semantic), StructuredBundle(structured, features))
    assert {r.model for r in found.collect()} == {"semantic", "structured"}
    scored = score_events(source, SemanticBundle(semantic)).collect()
    assert len(scored) == 200 and all(r.prediction != "error" for r in scored)


def test_ranking_gradient():
    rng = np.random.default_rng(3)
    w, a, b = np.eye(4) + rng.normal(size=(4, 4)) / 10, rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    _, gradient = ranking_loss(w, a, b)
    for i in range(4):
        for j in range(4):
            up, down = w.copy(), w.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            slope = (ranking_loss(up, a, b)[0] - ranking_loss(down, a, b)[0]) / 2e-6
            assert gradient[i, j] == pytest.approx(slope, abs=1e-5)


def test_projection_learns(spark, tmp_path):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(24, 5))
    b = a[:, ::-1]
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "text_vector array<double>, entity_vector array<double>")
    w, losses = fit_projection(df, batch=8, epochs=6, lr=0.05, repeat=1)
    assert losses[-1] < losses[0]
    save_projection(w, spark, str(tmp_path / "p"))
    assert load_projection(spark, str(tmp_path / "p")) == pytest.approx(w)


def test_sums_reduce_to_what_the_driver_can_hold(spark, monkeypatch):
    from opswatch.operators import partition_sums as ps

    def work(batches):
        return np.array([sum(b.num_rows for b in batches), 1.0])

    data = spark.range(1000).repartition(40)
    for limit in (8, 64, 1 << 20):
        monkeypatch.setattr(ps, "DRIVER_BYTES", limit)
        assert ps.partition_sums(data, work, size=2).tolist() == [1000.0, 40.0]


def test_long_sums_reach_the_driver_once(spark, monkeypatch):
    """Of vectors as long as a network's weights only the sum is collected, whatever the number of tasks."""
    from opswatch.operators import partition_sums as ps

    size, taken = 150_000, []

    def work(batches):
        return np.arange(size, dtype=np.float64) + sum(b.num_rows for b in batches)

    def counted(df):
        rows = collect(df)
        taken.append(sum(len(r["v"]) for r in rows))
        return rows

    data = spark.range(1000).repartition(40)
    collect = type(data).collect
    monkeypatch.setattr(type(data), "collect", counted)
    found = ps.partition_sums(data, work, size)
    assert found.tolist() == (np.arange(size) * 40.0 + 1000).tolist()
    assert sum(taken) == 8 * size
    assert ps.partition_sums(spark.range(0), lambda batches: None, size) is None


def test_adam_in_parts(monkeypatch):
    """Updates of some rows at a time are those of all rows."""
    from opswatch.operators import autoencoder

    rng, found = np.random.default_rng(7), []
    gradients = rng.normal(size=(3, 50, 2))
    for rows in (7, 1000):
        monkeypatch.setattr(autoencoder, "_STEP_ROWS", rows)
        adam, w = autoencoder.Adam(0, 0.1), np.ones((50, 2))
        adam.m, adam.v = np.zeros((50, 2)), np.zeros((50, 2))
        for g in gradients:
            w = adam.step(w, g)
        found.append(w)
    assert found[0].tolist() == found[1].tolist()


def test_a_step_per_batch_in_order(spark, monkeypatch):
    """Runs of steps that tasks take one after another are the steps of one job each."""
    from opswatch.operators import projection

    rng = np.random.default_rng(5)
    pairs = [(rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for _ in range(30)]
    df = spark.createDataFrame(pairs, "text_vector array<double>, entity_vector array<double>").coalesce(1)
    found = []
    for rows in (1, 16, 4096):
        monkeypatch.setattr(projection, "CHAIN_ROWS", rows)
        found.append(fit_projection(df, batch=4, epochs=3, lr=0.05, repeat=2))
    for w, losses in found[1:]:
        assert w == pytest.approx(found[0][0]) and losses == pytest.approx(found[0][1])
    assert np.abs(found[0][0] - np.eye(4)).max() > 0.05


def test_projection_gain_takes_every_step(spark, monkeypatch):
    from opswatch.operators import autoencoder, projection
    from opswatch.plans import vectors

    rng = np.random.default_rng(6)
    pairs = [(i, "s", rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(20)]
    df = spark.createDataFrame(pairs, "page_id long, service string, text_vector array<double>, entity_vector array<double>")
    taken = []

    def counted(size, lr):
        taken.append(autoencoder.Adam(size, lr))
        return taken[-1]

    monkeypatch.setattr(projection, "Adam", counted)
    monkeypatch.setattr(vectors, "_pair_vectors", lambda *_: df)
    got = vectors.projection_gain(spark, "").collect()
    assert 400 <= taken[0].t <= 500  # 10 epochs of 50 batches, less the groups that the hash leaves empty
    gains = [(r["after"] - r["before"]) / r["before"] for r in got]
    assert len(got) == 20 and {round(r["avg_gain"], 6) for r in got} == {round(float(np.mean(gains)), 6)}
