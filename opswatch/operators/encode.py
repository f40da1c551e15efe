"""Text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opswatch.operators.arrow import float_lists
from opswatch.schemas import EMBEDDING_DIM

VECTOR = T.ArrayType(T.FloatType())

# The default encoder: sizes of the byte pieces, the hash factor, and the bytes hashed at a time.
PIECES = (3, 4)
FACTOR = 2_654_435_761
_SPAN = 1 << 20
#: Texts, and characters of them, that are encoded at a time (a longer text is one by itself).
_TEXTS, _CHARACTERS = 1_024, 1 << 20


def hashed_pieces(texts: pa.Array, dim: int) -> np.ndarray:
    """Signed counts of the hashed byte pieces of each lower-cased text, at unit length.

    A whole Arrow batch is one byte buffer, hashed a span at a time: memory is bounded by the span
    and the result, whatever the length of a text. A null text counts as empty.
    """
    rows = len(texts)
    if not rows:
        return np.empty((0, dim))
    kind = pa.large_string()
    lower = pc.utf8_lower(texts.cast(kind).fill_null(""))
    edges = [pa.scalar(c, kind) for c in ("<", ">", "")]
    padded = pc.binary_join_element_wise(edges[0], lower, edges[1], edges[2])
    ends = np.cumsum(np.asarray(pc.binary_length(padded)).astype(np.int64))
    data = np.frombuffer(padded.buffers()[2], np.uint8)[: ends[-1]]
    counts = np.zeros(rows * dim)
    for start in range(0, len(data), _SPAN):
        stop = min(start + _SPAN, len(data))
        # the bytes that begin a piece here, and those after them (zeros at the end of the buffer)
        after = data[start : stop + PIECES[-1] - 1].astype(np.uint64)
        after = np.append(after, np.zeros(stop - start + PIECES[-1] - 1 - len(after), np.uint64))
        own = _overlap(ends, start, stop)
        low, high = np.flatnonzero(own)[[0, -1]]
        place = np.repeat(np.arange(high - low + 1) * dim, own[low : high + 1])
        last = ends[low : high + 1] - start
        value = np.zeros(stop - start, np.uint64)
        for i in range(PIECES[-1]):
            value = (value << np.uint64(8)) | after[i : i + stop - start]
            if i + 1 not in PIECES:
                continue
            h = (value * np.uint64(FACTOR)) >> np.uint64(7)
            half = h >> np.uint64(1)
            slot = (half - half // np.uint64(dim) * np.uint64(dim)).view(np.int64)
            sign = (h & np.uint64(1)).view(np.int64) * 2.0 - 1.0
            for back in range(1, i + 1):  # no piece reaches over its text's end
                over = last - back
                sign[over[(over >= 0) & (over < stop - start)]] = 0.0
            counts[low * dim : (high + 1) * dim] += np.bincount(place + slot, sign, (high - low + 1) * dim)
    vectors = counts.reshape(rows, dim)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def _overlap(ends: np.ndarray, start: int, stop: int) -> np.ndarray:
    """How many bytes of the span belong to each row."""
    return np.diff(np.clip(np.concatenate([[0], ends]), start, stop))


def encode(
    df: DataFrame,
    col: str = "semantic_text",
    out: str = "embedding",
    encoder: Callable[[], Any] | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Add a vector of the whole text; a text that cannot be encoded gets an empty one.

    The default is ``hashed_pieces``. ``encoder`` plugs in a model instead: a picklable function,
    called once per Python worker, that returns an object with
    ``encode(list of texts) -> rows of numbers``.
    """
    return df.withColumn(out, over_vectors(col, VECTOR, float_lists, pa.array([[]], pa.list_(pa.float32())), encoder, dim))


def over_vectors(
    col: str,
    returns: T.DataType,
    result: Callable[[np.ndarray], pa.Array],
    missing: pa.Array,
    encoder: Callable[[], Any] | None = None,
    dim: int = EMBEDDING_DIM,
) -> Column:
    """``result`` of the vectors of a text column, in the same stage that encodes the text.

    ``result`` maps a matrix to one value per row; the value in ``missing`` stands for a text that cannot be
    encoded. Vectors are 32-bit numbers. The length of the text goes along, to cut a batch into parts and to keep the
    optimizer from folding the expression that makes the text into this stage.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = Hashed(dim) if encoder is None else encoder()
        for texts, lengths in batches:
            found = [missing[:0]]
            for some in _slices(lengths.fill_null(0).to_numpy(zero_copy_only=False)):
                vectors = _encoded(model, texts[some].to_pylist())
                sizes = np.array([len(v) for v in vectors])
                # the values of each size of vector after the missing one, and where each text's is among these
                parts, place, upto = [missing], np.zeros(len(vectors), np.int64), 1
                for size in np.unique(sizes[sizes > 0]):
                    same = np.flatnonzero(sizes == size)
                    parts.append(result(np.stack([vectors[i] for i in same])))
                    place[same] = upto + np.arange(len(same))
                    upto += len(same)
                found.append(pa.concat_arrays(parts).take(pa.array(place)))
            yield pa.concat_arrays(found)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # Not declared deterministic: the optimizer would encode once more in each filter that it derives from the result.
    return F.arrow_udf(run, returns).asNondeterministic()(F.col(col), F.length(col))


def encoded_parts(
    batches: Iterator[pa.RecordBatch], col: str, encoder: Callable[[], Any] | None, dim: int
) -> Iterator[tuple[pa.RecordBatch, slice, list[np.ndarray]]]:
    """Each batch with some of its rows at a time and the vectors of their texts, empty where there is none."""
    model = Hashed(dim) if encoder is None else encoder()
    for batch in batches:
        texts = batch.column(col)
        for some in _slices(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
            yield batch, some, _encoded(model, texts[some].to_pylist())


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    """Cuts of a batch by the number and the characters of its texts, so that memory does not follow from the batch."""
    start = 0
    upto = np.cumsum(lengths)
    while start < len(lengths):
        before = upto[start] - lengths[start]
        stop = int(np.searchsorted(upto, before + _CHARACTERS, "right"))
        stop = min(max(stop, start + 1), start + _TEXTS)
        yield slice(start, stop)
        start = stop


class Hashed:
    """The default encoder behind the plug-in interface; a null text has no vector."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        vectors = hashed_pieces(pa.array(texts, pa.large_string()), self.dim).astype(np.float32)
        return [v if t is not None else v[:0] for t, v in zip(texts, vectors)]


def _encoded(model: Any, texts: list[str | None]) -> list[np.ndarray]:
    try:
        return [np.asarray(v, dtype=np.float32) for v in model.encode(texts)]
    except Exception:  # whatever a plugged-in model raises means "no vector": find the rows
        return [_one(model, t) for t in texts]


def _one(model: Any, text: str | None) -> np.ndarray:
    try:
        return np.asarray(model.encode([text])[0], dtype=np.float32)
    except Exception:
        return np.empty(0, dtype=np.float32)
