"""Micro-batches written once each, under one version of what they are worked out with.

A micro-batch is replayed after a failure between its write and its commit. Its folder is named by the batch id, so a
replay finds what is already there; the version of the model (or catalogue) it was begun with is written before
any of its rows, so a replay never mixes two versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opswatch.versions import listed, versions

Work = Callable[[DataFrame, int], DataFrame]


def _whole(spark: SparkSession, folder: str) -> bool:
    return "_SUCCESS" in listed(spark, folder)


def _version_of(spark: SparkSession, path: str, batch: int, source: str) -> int:
    """The version a batch works with: the newest when it was first begun."""
    pin = f"{path}/_versions/batch={batch}"
    if not _whole(spark, pin):
        found = versions(spark, source)
        if not found:
            raise FileNotFoundError(f"no whole version beneath {source}")
        spark.createDataFrame([(found[-1],)], "version long").coalesce(1).write.mode("overwrite").parquet(pin)
    return spark.read.parquet(pin).first()["version"]


def write_once(path: str, source: str, work: Work, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: ``work(rows, version)`` of each batch to a folder of its own beneath ``path``.

    ``source`` is where versions are published; each batch takes the newest one. A batch that is already whole is left as it is.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark, folder = rows.sparkSession, f"{path}/batch={batch}"
        if _whole(spark, folder):
            return
        version = _version_of(spark, path, batch, source)
        work(rows, version).write.mode("overwrite").format(fmt).save(folder)

    return run


def start_batches(
    df: DataFrame,
    path: str,
    checkpoint: str,
    source: str,
    work: Work,
    fmt: str = "parquet",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run a stream through ``write_once``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = df.writeStream.foreachBatch(write_once(path, source, work, fmt))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The rows of all whole batches beneath ``path``; one that is being written is not seen."""
    names = [n for n in listed(spark, path) if n.startswith("batch=")]
    whole = [f"{path}/{n}" for n in names if _whole(spark, f"{path}/{n}")]
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(whole)
