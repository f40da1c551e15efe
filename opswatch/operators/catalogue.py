"""An index of entity vectors, written once in blocks and met by any number of tables or micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opswatch.operators.arrow import matrix
from opswatch.operators.rootcause import CANDIDATES, best_columns, unit_rows
from opswatch.session import cut_lineage
from opswatch.versions import publish, published

#: Entities of a block and rows of a slice: their product is what one task holds of similarities, in pieces.
BLOCK = 8_192
_PIECE_VALUES = 4_000_000
_BLOCKS = "block int, dim int, names array<string>, ords array<long>, vectors binary"


def publish_index(
    entities: DataFrame,
    path: str,
    name: str = "service_name",
    vector: str = "vector",
    order: str = "ord",
    block: int = BLOCK,
) -> int:
    """Write unit vectors of ``entities`` as one row per block of about ``block`` of them; returns the version.

    Entities are dealt to blocks by a hash of their order, so a block is bounded whatever the catalogue's size.
    Vectors of several lengths are kept apart; entities without a vector are left out.
    """
    known = entities.where(F.size(vector) > 0)
    blocks = max(1, -(-known.count() // block))
    dealt = known.select(
        F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int").alias("block"),
        F.size(vector).alias("dim"),
        F.col(name).cast("string").alias("name"),
        F.col(order).cast("long").alias("ord"),
        F.col(vector).cast("array<double>").alias("vector"),
    )

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ord", "ascending"), ("name", "ascending")]).combine_chunks()
        dim = rows.column("dim")[0].as_py()
        unit = unit_rows(matrix(rows.column("vector").combine_chunks(), dim))
        columns = [
            pa.array([rows.column("block")[0].as_py()], pa.int32()), pa.array([dim], pa.int32()),
            pa.array([rows.column("name").to_pylist()], pa.list_(pa.string())),
            pa.array([rows.column("ord").to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary()),
        ]
        return pa.table(columns, names=["block", "dim", "names", "ords", "vectors"])

    packed = dealt.groupBy("block", "dim").applyInArrow(pack, _BLOCKS)
    return publish(entities.sparkSession, path, {"blocks": packed})


def load_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(published(spark, path, version)["blocks"])


def indexed_candidates(
    df: DataFrame, index: DataFrame, k: int = 3, vector: str = "embedding", slice_rows: int = BLOCK
) -> DataFrame:
    """Add ``candidates``: the ``k`` entities of highest cosine, best first, ties in the entities' order.

    Rows are packed into slices; each slice meets each block of its vectors' length once, as one product of matrices, and keeps ``k``
    per row. Nothing is broadcast, and no task holds more than a slice and a block. A row without a vector of a known length gets null.
    """
    rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                for start in range(0, len(at), slice_rows):
                    some = pa.array(at[start : start + slice_rows])
                    unit = unit_rows(matrix(lists.take(some), int(dim)))
                    columns = [
                        pa.array([number], pa.int64()), pa.array([dim], pa.int32()),
                        pa.array([ids.take(some).to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["slice", "dim", "rows", "asked"])
                    number += 1

    slices = rows.select("__row", F.col(vector).cast("array<double>")).mapInArrow(
        pack, "slice long, dim int, rows array<long>, asked binary"
    )
    # a slice is copied once per block it meets, a block once per slice: the products that are asked for
    met = slices.join(index, "dim").repartition("slice", "block")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                known = np.frombuffer(pair["vectors"]).reshape(-1, pair["dim"])
                asked = np.frombuffer(pair["asked"]).reshape(-1, pair["dim"])
                ids, names, ords = np.array(pair["rows"]), pa.array(pair["names"], pa.string()), np.array(pair["ords"])
                step = max(1, _PIECE_VALUES // len(known))
                for start in range(0, len(asked), step):
                    similarity = asked[start : start + step] @ known.T
                    columns = best_columns(similarity, k)
                    values = np.take_along_axis(similarity, columns, 1)
                    found = [
                        pa.array(np.repeat(ids[start : start + step], columns.shape[1])),
                        names.take(pa.array(columns.ravel())), pa.array(ords[columns.ravel()]), pa.array(values.ravel()),
                    ]
                    yield pa.RecordBatch.from_arrays(found, ["__row", "entity", "ord", "confidence"])

    found = met.mapInArrow(products, "__row long, entity string, ord long, confidence double")
    ranking = Window.partitionBy("__row").orderBy(F.desc("confidence"), "ord", "entity")
    ranked = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
    pair = F.struct("rank", "entity", "confidence")
    best = ranked.groupBy("__row").agg(F.array_sort(F.collect_list(pair)).alias("__best"))
    pairs = F.transform("__best", lambda b: F.struct(b["entity"], b["confidence"]))
    joined = rows.join(best, "__row", "left").withColumn("candidates", pairs.cast(CANDIDATES))
    return joined.drop("__row", "__best")
