"""What the driver holds while a network with a long vector of weights is trained."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from opswatch.operators import partition_sums as ps
from opswatch.operators.autoencoder import Adam
from opswatch.operators.wide import _out_gradient, _step_head


def test_steps_in_place_are_adams_and_hold_little_beside_the_weights():
    rng, hidden, n, rows = np.random.default_rng(1), 16, 20_000, 50.0
    width = 2 * hidden + 1
    places, own, hh = rng.normal(size=(n, width)), rng.normal(size=(n, width)), rng.normal(size=(hidden + 1, hidden + 1))
    plain, want = Adam(n * width, 0.01), places.copy()
    adam = Adam(0, 0.01)
    adam.m, adam.v = np.zeros_like(places), np.zeros_like(places)
    for _ in range(3):
        gradient = _out_gradient(own, want[:, hidden:], hh, 100, hidden) / rows
        want = plain.step(want.ravel(), gradient.ravel()).reshape(want.shape)
        tracemalloc.start()
        _step_head(places, adam, own, hh, 100, rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert places == pytest.approx(want, rel=1e-12) and peak < places.nbytes
    assert adam.m.ravel() == pytest.approx(plain.m, rel=1e-12) and adam.v.ravel() == pytest.approx(plain.v, rel=1e-12)


def test_long_sums_reach_the_driver_in_small_parts(spark, monkeypatch):
    """No row fills half a region of a small heap (0.5 MB): such ones stay until the heap has grown."""
    size, sent, collect = 1_000_003, [], DataFrame.collect

    def recorded(self):
        found = collect(self)
        sent.extend(len(r["v"]) for r in found)
        return found

    def vectors(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                v = np.arange(size, dtype=np.float64) + i
                yield pa.RecordBatch.from_pydict({"v": pa.array([v.tobytes()], pa.binary())})

    monkeypatch.setattr(DataFrame, "collect", recorded)
    total = ps.vector_sum(spark.range(0, 5, 1, 3).mapInArrow(vectors, "v binary"), size)
    assert np.array_equal(total, 5 * np.arange(size) + 10.0)
    assert sum(sent) == 8 * size and max(sent) < 1 << 18
    assert ps.vector_sum(spark.range(0).mapInArrow(vectors, "v binary"), size) is None
