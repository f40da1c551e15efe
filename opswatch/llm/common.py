"""What several of the text operators share."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.session import cut_lineage

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a broadcast table may take; larger tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: a split that does not move when rows are added."""
    return (F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n).cast("int")


def release() -> None:
    """Hand freed memory back to the system, so that idle workers of earlier stages hold little."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether a materialised table is small enough to broadcast, by its counted rows."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def join_counted(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, row_bytes: int = 64) -> DataFrame:
    """A join whose right side is broadcast when its counted size allows and shuffled otherwise.

    ``right`` is counted, so it should be materialised. The rows are the same either way.
    """
    return left.join(F.broadcast(right) if small(right, row_bytes) else right, on, how)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``key`` (a number of its own for each row) and ``row`` (all its columns): written once, so that keys stay.

    Whatever the columns are called, nothing that is joined to the key can clash with them.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("key"), whole.alias("row")))


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text``; of rows that repeat an id, one with the least text that is not null.

    The ids are counted first; texts are shuffled only for ids that do repeat. Rows without an id stay as they are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = cut_lineage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs
    once = join_counted(docs, repeated, ["doc_id"], "left_anti", 16)
    several = join_counted(docs, repeated, ["doc_id"], "left_semi", 16)
    return once.unionByName(several.groupBy("doc_id").agg(F.min("text").alias("text")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one) over unsigned numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) decided by the keys alone: counters in place of a generator's state."""
    state = np.uint64(0x9E3779B97F4A7C15)
    for key in keys:
        with np.errstate(over="ignore"):
            state = mix64(np.asarray(key).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ state)
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
