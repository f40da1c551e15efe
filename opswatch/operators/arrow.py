"""Arrow functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def over_arrays(
    fn: Callable[..., pa.Array], returns: T.DataType, *cols: str
) -> Column:
    """``fn`` over whole Arrow batches of ARRAY columns.

    The lengths go along unused: a second reference to a column keeps the optimizer from folding
    the expression that makes it into this stage, where functions of the JVM cannot be evaluated.
    The function is not declared deterministic, as it would be run once more in each filter that is derived from its result.
    """
    n = len(cols)

    def run(*args: pa.Array) -> pa.Array:
        return fn(*args[:n])

    run.__annotations__ = {"args": pa.Array, "return": pa.Array}
    lengths = [F.size(c) for c in cols]
    return F.arrow_udf(run, returns).asNondeterministic()(*[F.col(c) for c in cols], *lengths)


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), dim)


def float_lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column of 32-bit numbers."""
    rows, dim = values.shape
    offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values, np.float32).ravel())
