"""Scaler, one-hot vocabulary and the structured feature rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opswatch import schemas
from opswatch.functions import to_number
from opswatch.operators.arrow import matrix
from opswatch.operators.partition_sums import partition_sums
from opswatch.session import cut_lineage
from opswatch.versions import publish, published

# The most frequent values, whose weights the driver and every task hold; the others stay a table.
HEAD = 16_384
MAX_PLAIN_VALUES = 1_000_000
_SCALER = "mean array<double>, scale array<double>, n bigint"


def valid_embeddings(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Rows whose vector is present and has ``dim`` numbers."""
    return df.where(F.col(col).isNotNull() & (F.size(col) == dim))


def select_features(
    df: DataFrame,
    numeric: Sequence[str] = tuple(schemas.NUMERIC_COLUMNS),
    categorical: Sequence[str] = tuple(schemas.CATEGORICAL_COLUMNS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Numbers coerced (0.0 when bad or missing) and categories as text ("unknown" when missing)."""
    present = set(df.columns)

    def category(name: str):
        if name not in present:
            return F.lit("unknown")
        return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))

    numbers = [
        (to_number(F.col(c)) if c in present else F.lit(0.0)).alias(c) for c in numeric
    ]
    return df.select(*keep, *numbers, *[category(c).alias(c) for c in categorical])


def fit_scaler(df: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: ``mean``, ``scale`` (population deviation, 1 for a constant dimension) and ``n``.

    Sums and sums of squares are taken about one of the vectors, so that large means do not cost
    digits, as one vector per partition. No row without vectors.
    """
    vectors = df.select(F.col(col).cast("array<double>").alias("x")).where(F.size("x") > 0)
    spark = df.sparkSession
    first = vectors.first()
    if first is None:
        return spark.createDataFrame([], _SCALER)
    pivot = np.asarray(first["x"])

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n, total, squares = 0, np.zeros(len(pivot)), np.zeros(len(pivot))
        for batch in batches:
            x = matrix(batch.column(0), len(pivot)) - pivot
            n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
        return np.concatenate([[n], total, squares])

    sums = partition_sums(vectors, work)
    n, (total, squares) = sums[0], np.split(sums[1:], 2)
    variance = np.maximum(squares / n - (total / n) ** 2, 0.0)
    # Rounding may leave a trace of variance in a constant dimension.
    constant = variance <= 1e-15 * (squares / n)
    scale = np.where(constant, 1.0, np.sqrt(variance))
    row = ((pivot + total / n).tolist(), scale.tolist(), int(n))
    return spark.createDataFrame([row], _SCALER)


def fit_onehot(
    df: DataFrame, cols: Sequence[str], max_plain_values: int = MAX_PLAIN_VALUES
) -> DataFrame:
    """``column, value, idx``: the values of each column numbered from 0 in text order.

    Values are made distinct first, so a value that fills most rows costs one row per task. A
    vocabulary too long to number in one task per column is range partitioned, materialised, and
    numbered from the row counts of its partitions.
    """
    return _counted_values(df, cols, max_plain_values).select("column", "value", "idx")


def _counted_values(df: DataFrame, cols: Sequence[str], max_plain_values: int) -> DataFrame:
    """``column, value, n, idx``: the numbered values of ``fit_onehot`` and the rows of each."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    )
    values = df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull())
    values = cut_lineage(values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    if values.count() <= max_plain_values:
        by_value = Window.partitionBy("column").orderBy("value")
        return values.withColumn("idx", (F.row_number().over(by_value) - 1).cast("bigint"))

    ranged = cut_lineage(
        values.repartitionByRange("column", "value")
        .sortWithinPartitions("column", "value")
        .select("column", "value", "n", F.monotonically_increasing_id().alias("__id"))
    )
    # The upper bits of the id are the partition, the lower 33 the position in it.
    part = F.shiftright("__id", 33)
    placed = ranged.withColumn("__part", part).withColumn(
        "__pos", F.col("__id") - F.shiftleft("__part", 33)
    )
    runs = placed.groupBy("column", "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__from")
    )
    before = (
        Window.partitionBy("column").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most one row per column and partition: small whatever the length of the vocabulary.
    offsets = runs.select(
        "column",
        "__part",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")).alias("__offset"),
    )
    return placed.join(F.broadcast(offsets), ["column", "__part"]).select(
        "column", "value", "n", (F.col("__pos") + F.col("__offset")).alias("idx")
    )


@dataclass
class FeatureModel:
    """Fitted scaler of the numeric columns and vocabulary of the categorical ones.

    ``labels`` are each category's most frequent values, in text order, and ``positions`` their places in the feature vector. The
    other values, if there are any, are the table ``tail``: ``category, value, j`` (its place), and ``width`` counts all places.
    """

    numeric: list[str]
    categorical: list[str]
    mean: list[float]
    scale: list[float]
    labels: list[list[str]] = field(repr=False)
    positions: list[list[int]] = field(repr=False)
    width: int
    tail: DataFrame | None = field(default=None, repr=False)

    @property
    def head_positions(self) -> list[int]:
        """Places of the numbers and of the values in ``labels``."""
        return [*range(len(self.numeric)), *(p for places in self.positions for p in places)]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Add ``numbers`` (standardised), ``hot`` (places of the ones among numbers and ``labels``) and ``rare``.

        Numbers come first, then one block per category. ``rare`` are ``category, value`` of the
        values outside ``labels``: those of ``tail`` and those not seen in fitting, which have no
        place. It is left out where there is no tail. The dense vector is never built: a row is as long as its categories, whatever
        the width.
        """
        rows = select_features(df, self.numeric, self.categorical, keep)
        numbers = F.array(
            *[
                (F.col(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.numeric, self.mean, self.scale)
            ]
        ).cast("array<double>")
        if not self.categorical:
            return rows.select(
                *keep, numbers.alias("numbers"), F.array().cast("array<int>").alias("hot")
            )
        coded = [f"__i_{c}" for c in self.categorical]
        indexer = StringIndexerModel.from_arrays_of_labels(
            self.labels, inputCols=self.categorical, outputCols=coded, handleInvalid="keep"
        )
        positions, others, start = [], [], len(self.numeric)
        for i, (name, code, labels) in enumerate(zip(self.categorical, coded, self.labels)):
            known = F.col(code) < len(labels)
            positions.append(F.when(known, (F.col(code) + start).cast("int")))
            other = F.struct(F.lit(i).alias("category"), F.col(name).alias("value"))
            others.append(F.when(~known, other))
            start += len(labels)
        rare = F.filter(F.array(*others), lambda v: v.isNotNull())
        hot = F.filter(F.array(*positions), lambda i: i.isNotNull())
        return indexer.transform(rows).select(
            *keep, numbers.alias("numbers"), hot.alias("hot"),
            *([rare.alias("rare")] if self.tail is not None else []),
        )


def fit_features(
    df: DataFrame,
    numeric: Sequence[str] = tuple(schemas.NUMERIC_COLUMNS),
    categorical: Sequence[str] = tuple(schemas.CATEGORICAL_COLUMNS),
    head: int = HEAD,
) -> FeatureModel:
    """Fit scaler and vocabulary of structured rows; any number of distinct values.

    At most ``head`` values, the most frequent, reach the driver. The others stay a table, numbered by the same rule, so that ``head``
    decides where a weight is kept and never what it is.
    """
    rows = select_features(df, numeric, categorical)
    numbers = F.array(*[F.col(c) for c in numeric]).cast("array<double>")
    fitted = fit_scaler(rows.select(numbers.alias("x")), "x").first() if numeric else None
    if numeric and fitted is None:
        raise ValueError("no rows to fit features on")
    labels: list[list[str]] = [[] for _ in categorical]
    positions: list[list[int]] = [[] for _ in categorical]
    width, tail = len(numeric), None
    if categorical:
        vocabulary = cut_lineage(_counted_values(rows, categorical, MAX_PLAIN_VALUES))
        sizes = {r["column"]: r["count"] for r in vocabulary.groupBy("column").count().collect()}
        starts, order = {}, {c: i for i, c in enumerate(categorical)}
        for c in categorical:
            starts[c] = width
            width += sizes.get(c, 0)
        # one entry per category
        start = F.create_map(*[F.lit(x) for c in categorical for x in (c, starts[c])])
        category = F.create_map(*[F.lit(x) for c in categorical for x in (c, order[c])])
        placed = vocabulary.select(
            category[F.col("column")].alias("category"), "value", "n",
            (F.col("idx") + start[F.col("column")]).alias("j"),
        )
        kept = placed
        if width - len(numeric) > head:
            kept = cut_lineage(placed.orderBy(F.desc("n"), "j").limit(head).select("category", "value", "j"))
            tail = cut_lineage(placed.join(F.broadcast(kept.select("j")), "j", "left_anti").select("category", "value", "j"))
        for row in kept.orderBy("j").collect():
            labels[row["category"]].append(row["value"])
            positions[row["category"]].append(row["j"])
    return FeatureModel(
        numeric=list(numeric),
        categorical=list(categorical),
        mean=list(fitted["mean"]) if fitted else [],
        scale=list(fitted["scale"]) if fitted else [],
        labels=labels,
        positions=positions,
        width=width,
        tail=tail,
    )


def save_features(model: FeatureModel, spark: SparkSession, path: str) -> None:
    """A new version of the features beneath ``path``; readers keep the one they have."""
    schema = (
        "numeric array<string>, categorical array<string>, mean array<double>, scale array<double>, "
        "labels array<array<string>>, positions array<array<long>>, width long"
    )
    row = (model.numeric, model.categorical, model.mean, model.scale, model.labels, model.positions, model.width)
    parts = {"features": spark.createDataFrame([row], schema)}
    publish(spark, path, parts | ({} if model.tail is None else {"tail": model.tail}))


def load_features(spark: SparkSession, path: str, version: int | None = None) -> FeatureModel:
    parts = published(spark, path, version)
    row = spark.read.parquet(parts["features"]).first()
    return FeatureModel(
        list(row["numeric"]),
        list(row["categorical"]),
        list(row["mean"]),
        list(row["scale"]),
        [list(v) for v in row["labels"]],
        [list(v) for v in row["positions"]],
        row["width"],
        spark.read.parquet(parts["tail"]) if "tail" in parts else None,
    )
