"""Nearest neighbours by an inverted file whose lists are scanned with adaptive numbers of dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opswatch.llm.common import join_counted, uniform
from opswatch.session import cut_lineage

#: Numbers in the sample that the lists' centres and the count of probed lists are fitted on.
SAMPLE_VALUES = 1_500_000
MOST_LISTS = 1024
#: Recall that the count of probed lists reaches on the sample.
TARGET_RECALL = 0.97
#: Vectors and queries that meet in one task.
BLOCK_ROWS = 4096
#: Dimensions that each step of the scan adds, and the width of its test.
STEP_DIMS = 16
EPSILON = 2.1
_CELLS = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    numbers = vector.cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(numbers, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    rows = len(lists)
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(rows, -1 if rows else 0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


@dataclass(frozen=True)
class Lists:
    """Centres of the lists, a rotation, and how many lists a query probes."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        return _squares(vectors, self.centres).argmin(axis=1)

    def probed(self, vectors: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists that each query probes, one after another, and how many: more where they hold too few rows."""
        order = np.argsort(_squares(vectors, self.centres), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
        many = np.minimum(np.maximum(enough, self.probes), order.shape[1])
        return order[np.arange(order.shape[1]) < many[:, None]], many


def fit_lists(vectors: DataFrame, rows: int, dim: int, k: int = 10, rounds: int = 8) -> Lists:
    """Centres by k-means on the first vectors by a hash of their id, at most ``SAMPLE_VALUES`` numbers.

    Probes are the fewest lists that hold ``TARGET_RECALL`` of the ``k`` nearest sample rows of 200 of them. In the whole
    table the nearest rows are nearer than in the sample, and so in nearer lists.
    """
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE_VALUES // dim)).select("vector")
    sample = _matrix(some.toArrow().column(0))
    lists = int(min(MOST_LISTS, len(sample), max(1, np.sqrt(rows) / 2)))
    centres = np.unique(sample[:lists], axis=0)  # equal centres would share rows by rounding
    for _ in range(rounds):
        of = _squares(sample, centres).argmin(axis=1)
        count = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        centres = np.unique(sums[count > 0] / count[count > 0, None], axis=0)
    noise = uniform(np.arange(dim * dim), 7).reshape(dim, dim) + uniform(np.arange(dim * dim), 8).reshape(dim, dim) - 1.0
    rotation, _ = np.linalg.qr(noise)
    queries = np.arange(min(200, len(sample)))
    distance = _squares(sample[queries], sample)
    distance[queries, queries] = np.inf
    near = np.argsort(distance, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(_squares(sample[queries], centres), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(place, _squares(sample, centres).argmin(axis=1)[near], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(TARGET_RECALL * len(depth))))]) + 1 if len(depth) else 1
    return Lists(centres, rotation, min(len(centres), probes))


def scan(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest found among ``vectors``: query numbers, ids and distances.

    Both are rotated, so that any leading dimensions are a random share of the distance. Partial squared distances grow by
    ``STEP_DIMS`` columns. A pair is abandoned when the distance estimated from ``d`` of ``D`` dimensions exceeds the
    query's k-th best by more than chance allows: partial * D / d > best * (1 + epsilon / sqrt(d)) ** 2. The first
    bound of a query is the k-th exact distance among those with the smallest first part.
    """
    dim = vectors.shape[1]
    rq, rv = queries @ rotation, vectors @ rotation
    cuts = [*range(0, dim, STEP_DIMS), dim]
    out_q, out_v, out_d = [], [], []
    chunk = max(1, _CELLS // max(1, len(vectors)))
    for at in range(0, len(queries), chunk):
        q = rq[at : at + chunk]
        self_pair = query_ids[at : at + chunk, None] == ids[None, :]
        part = _squares(q[:, : cuts[1]], rv[:, : cuts[1]])
        part[self_pair] = np.inf
        m = min(2 * k, len(vectors))
        head = np.argpartition(part, m - 1, axis=1)[:, :m]
        exact = ((q[:, None, :] - rv[head]) ** 2).sum(axis=2)
        exact[np.take_along_axis(self_pair, head, axis=1)] = np.inf
        bound = np.sort(exact, axis=1)[:, k - 1] if m >= k else np.full(len(q), np.inf)
        bound = bound * (1 + 1e-9) + 1e-9 * (q * q).sum(axis=1)  # rounding; distances are taken anew below
        done = cuts[1]
        test = bound * (1 + EPSILON / np.sqrt(done)) ** 2 * done / dim if done < dim else bound
        qi, vi = np.nonzero((part <= test[:, None]) & np.isfinite(part))
        partial = part[qi, vi]
        for nxt in cuts[2:]:
            partial = partial + ((q[qi, done:nxt] - rv[vi, done:nxt]) ** 2).sum(axis=1)
            done = nxt
            limit = bound[qi] * (1 + EPSILON / np.sqrt(done)) ** 2 * done / dim if done < dim else bound[qi]
            stay = partial <= limit
            qi, vi, partial = qi[stay], vi[stay], partial[stay]
        distance = np.sqrt(((queries[at + qi] - vectors[vi]) ** 2).sum(axis=1))
        order = np.lexsort((ids[vi], distance, qi))
        qi, vi, distance = qi[order], vi[order], distance[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = rank < k
        out_q.append(at + qi[best])
        out_v.append(vi[best])
        out_d.append(distance[best])
    if not out_q:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    found = np.concatenate(out_v)
    return np.concatenate(out_q), ids[found], np.concatenate(out_d)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """``vec_id`` and ``vector`` of the rows that take part, their number and dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    ids = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim"))
    common = ids.first()
    if common is None:
        return rows, 0, 0
    rows = rows.where(F.size("vector") == common["dim"])
    repeated = cut_lineage(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if not repeated.isEmpty():
        several = join_counted(rows, repeated, ["vec_id"], "left_semi", 16).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        rows = join_counted(rows, repeated, ["vec_id"], "left_anti", 16).unionByName(several)
    return rows, common["n"], common["dim"]


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` nearest other vectors found for every vector whose id is divisible by ``every``.

    Columns: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (the Euclidean distance of the original vectors in
    double precision); ties go to the smaller id. Vectors that are null, all zero, or hold a null or non-finite
    component take no part, nor do rows without an id or of another length than the most frequent one (of
    equally frequent ones the greatest). Of rows that repeat an id the least vector counts. Other columns
    are ignored; a table without usable vectors gives no rows.

    Every vector is put in the list of its nearest centre. A list above ``block_rows`` is divided into blocks, as are the
    queries that probe it, so a list that holds a third of all rows is many tasks. In each the queries scan the
    block with adaptive dimensions; the blocks' results are merged per query.
    """
    spark = vectors.sparkSession
    rows, count, dim = _prepared(vectors, id_col, vector_col)
    if not count:
        return spark.createDataFrame([], RESULT)
    held = spark.sparkContext.broadcast(fit_lists(rows, count, dim, k))  # at most MOST_LISTS centres
    kind = rows.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = held.value.own(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["vec_id", "vector", "list"])

    placed = rows.mapInArrow(assign, f"vec_id long, vector {kind}, list long")
    in_lists = np.zeros(len(held.value.centres), np.int64)
    for r in placed.groupBy("list").count().collect():  # a row per list
        in_lists[r["list"]] = r["count"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists, many = held.value.probed(_matrix(batch.column(1)), in_lists, k)
                offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                columns = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "lists"])

    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(ask, f"vec_id long, vector {kind}, lists array<long>")
    asked = asked.select("vec_id", "vector", F.explode("lists").alias("list"))
    in_list = placed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    by_list = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("turns"))
    sizes = cut_lineage(in_list.join(by_list, "list"))  # a row per list
    placed, asked = (df.join(F.broadcast(sizes), "list") for df in (placed, asked))
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.select("list", own("blocks", 1).alias("block"), all_of("turns").alias("turn"), "vec_id", "vector")
    right = asked.select("list", all_of("blocks").alias("block"), "turns", "vec_id", "vector")
    right = right.select("list", "block", own("turns", 2).alias("turn"), "vec_id", "vector")

    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query_ids = np.asarray(block.column("vec_id")), np.asarray(queries.column("vec_id"))
        if len(ids) and len(query_ids):
            which, found, distance = scan(_matrix(queries.column("vector")), query_ids, _matrix(block.column("vector")), ids, held.value.rotation, k)
            columns = [pa.array(query_ids[which]), pa.array(found), pa.array(distance)]
        else:
            columns = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    keys = ("list", "block", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
