"""Sums of per-partition number vectors, reduced on executors before the driver sees them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

FAN_IN = 32
#: Vectors of more numbers are long: they are added up in pieces of ``_SOME`` numbers, dealt over at most ``_DEALT`` tasks. A
#: row is then under half a region of the driver's heap, so it goes with the young objects instead of making the heap grow.
PIECE = 1 << 16
_SOME, _DEALT = 1 << 14, 256
#: What may reach the driver at once; on its way through the driver's two processes it is held several times.
DRIVER_BYTES = 32 << 20
_SCHEMA = "v binary"


def _pack(vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"v": pa.array([vector.tobytes()], pa.binary())})


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(0):
            vector = _unpack(blob.as_py())
            total = vector.copy() if total is None else total + vector
    if total is not None:
        yield _pack(total)


def partition_sums(
    data: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None],
    size: int = 0,
) -> np.ndarray | None:
    """Sum of ``work`` over the partitions of ``data`` (None from an empty partition is skipped).

    At most ``FAN_IN`` vectors reach the driver, whatever the number of partitions, and fewer when
    ``size`` numbers in each of them would take more than ``DRIVER_BYTES``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = work(batches)
        if vector is not None:
            yield _pack(np.asarray(vector, dtype=np.float64))

    return vector_sum(data.mapInArrow(run, _SCHEMA), size)


def vector_sum(sums: DataFrame, size: int = 0) -> np.ndarray | None:
    """Sum of a column of packed number vectors, by the same steps; None without rows.

    Vectors of more than ``PIECE`` numbers are added up piece by piece, in the order of their tasks: only sums reach the driver.
    """
    if size > PIECE:
        return _piecewise(sums, size)
    most = max(1, min(FAN_IN, DRIVER_BYTES // (8 * size))) if size else FAN_IN
    parts = sums.rdd.getNumPartitions()
    while parts > most:
        parts = max(1, -(-parts // FAN_IN)) if parts > FAN_IN else most
        sums = sums.repartition(parts).mapInArrow(_add, _SCHEMA)
    vectors = [_unpack(bytes(r["v"])) for r in sums.collect()]
    return np.sum(vectors, axis=0) if vectors else None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seen = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for blob in batch.column(0):
            vector = _unpack(blob.as_buffer())
            pieces = [vector[a : a + _SOME].tobytes() for a in range(0, len(vector), _SOME)]
            columns = [pa.array(range(len(pieces)), pa.int32()), pa.array([task + seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "source", "v"])
            seen += 1


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pieces that come one after another."""
    piece, total = None, None
    for batch in batches:
        for number, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
            vector = _unpack(blob.as_buffer())
            if number == piece:
                total += vector
                continue
            if total is not None:
                yield _piece(piece, total)
            piece, total = number, vector.copy()
    if total is not None:
        yield _piece(piece, total)


def _piece(number: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})


def _piecewise(sums: DataFrame, size: int) -> np.ndarray | None:
    cut = sums.mapInArrow(_cut, "piece int, source long, v binary")
    dealt = cut.repartition(min(-(-size // _SOME), _DEALT), "piece").sortWithinPartitions("piece", "source")
    out, rows = None, dealt.mapInArrow(_add_pieces, "piece int, v binary").collect()
    while rows:  # what is in its place is let go
        row = rows.pop()
        out = np.empty(size) if out is None else out
        found = _unpack(row["v"])
        out[row["piece"] * _SOME :][: len(found)] = found
    if 8 * size > DRIVER_BYTES // 4:
        # the copies that the driver's heap has made of it are garbage; left there, the heap grows to its limit over the steps of a training
        sums.sparkSession.sparkContext._jvm.System.gc()
    return out
