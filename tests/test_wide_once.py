"""Structured training packs its rows and counts its values once."""

import pytest
from pyspark.sql import functions as F

from opswatch.operators import features, wide
from opswatch.operators.autoencoder import fit_threshold

ROWS = "a double, c string, d string"


def rows(spark):
    return spark.createDataFrame([(float(i % 7), f"v{i % 11}", f"w{i}" if i % 3 else None) for i in range(90)], ROWS)


@pytest.mark.parametrize("validation", [False, True])
def test_rows_are_packed_once(spark, monkeypatch, validation):
    df, packed = rows(spark), []
    model = features.fit_features(df, ["a"], ["c", "d"], head=4)
    pack = wide._packed
    monkeypatch.setattr(wide, "_packed", lambda x: packed.append(1) or pack(x))
    net, _ = wide.fit_wide(df, model, hidden=2, epochs=2, dropout=0.0, validation=validation)
    assert len(packed) == 1
    if not validation:
        looked_up = wide.wide_errors(model.transform(df), net)
        assert net.threshold == pytest.approx(fit_threshold(looked_up), rel=1e-12)
    assert net.threshold > 0


def test_values_are_counted_with_their_numbers(spark):
    for few in (1_000_000, 5):
        got = features._counted_values(rows(spark), ["c", "d"], few)
        assert {(r["column"], r["value"]): r["n"] for r in got.collect()} == {
            **{("c", f"v{k}"): sum(i % 11 == k for i in range(90)) for k in range(11)},
            **{("d", f"w{i}"): 1 for i in range(90) if i % 3},
        }
        assert [r["idx"] for r in got.where(F.col("column") == "c").orderBy("value").collect()] == list(range(11))
