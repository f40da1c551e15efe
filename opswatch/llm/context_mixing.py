"""Document scores by logistic mixing of hashed-context bit predictors, beside a word-count base line.

Texts are walked byte by byte. The contexts of a byte are the 1, 2, 3, 4 and 6 bytes before it, wherever words begin and
end, and the whole of its word so far. A *step* is a byte with all of its contexts: 6 bytes of history, the word so far where it is
longer, and the byte. Predictions depend on nothing else, so a step that recurs is counted, learnt from by its number and
scored once, and every position of every text takes its own step's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import id_bucket, mix64, release
from opswatch.llm.word_contexts import _WORDS, _answered, _at_levels, _table, with_contexts  # noqa: F401
from opswatch.operators.partition_sums import partition_sums
from opswatch.session import cut_lineage, spread

#: Bytes of text that one chunk of documents holds, and that one bucket of steps is made for, on average.
GROUP_BYTES = 12 << 20
#: Bytes before a byte that a step holds.
_REACH = 6
_ORDERS = (1, 2, 3, 4, 6, 0)  # bytes of context; 0 is the word so far
_K = len(_ORDERS)
_GATES = 64
_BUCKETS = 33
#: Positions whose contexts are held at once.
_PIECE = 2 << 20
#: Steps that are scored at once, and that move the weights at once.
_SCORED, _MOVED = 1 << 14, 1024
_SPACE = 32  # ends a word; after no word it ends the text
#: Words of fewer bytes are counted beside the contexts of one and two bytes.
_SHORT = 3
_BYTE = mix64(np.arange(1 << 10, (1 << 10) + 256, dtype=np.uint64)) | np.uint64(1)
_LONG = np.uint64(1 << 63)
_U = np.uint64


# --- texts to steps -----------------------------------------------------------------------------


def stream(text: bytes | None) -> tuple[bytes, int]:
    """What is predicted of a text, and its words: these with A-Z in lower case, a space after each, and a space that ends it."""
    words = text.lower().split() if text else []
    return b" ".join([*words, b" "] if words else [b" "]), len(words)


_OUT, _IN = 0x9E3779 | 1, pow(0x9E3779 | 1, -1, 1 << 24)


def _dealt(last: np.ndarray) -> np.ndarray:
    """The last three bytes, shuffled one to one, so that ranges of them are even."""
    last = last * _U(_OUT) & _U(0xFFFFFF)
    last = last ^ last >> _U(12)
    return last * _U(_OUT) & _U(0xFFFFFF)


def _undealt(last: np.ndarray) -> np.ndarray:
    last = last * _U(_IN) & _U(0xFFFFFF)
    last = last ^ last >> _U(12)
    return last * _U(_IN) & _U(0xFFFFFF)


def _ids(data: np.ndarray) -> np.ndarray:
    """Of each byte after the first ``_REACH``, which start a word: a number that is the same only for the same step.

    It is the history and the byte, or where the word so far is longer than the history, the hash of that word and the byte.
    """
    x = data.astype(np.uint64)
    pair = x[1:] << _U(8) | x[:-1]
    four = pair[2:] << _U(16) | pair[:-2]
    now = x[_REACH:]
    n = len(now)
    ids = (four[2 : 2 + n] << _U(16) | pair[:n]) << _U(8) | now
    at = np.arange(n, dtype=np.int32)
    start = np.maximum.accumulate(np.where(data[_REACH - 1 : -1] == _SPACE, at, np.int32(0)))
    place = at - start
    far = np.flatnonzero(place >= _REACH)
    if len(far):
        with np.errstate(over="ignore"):
            odd = mix64(np.arange(1, int(place.max()) + 2, dtype=np.uint64)) | _U(1)
            each = _BYTE[data[_REACH:]] * odd[place]
            upto = np.cumsum(each, dtype=np.uint64) - each
            ids[far] = _LONG | mix64(upto[far] - upto[start[far]]) >> _U(9) << _U(8) | now[far]
    return ids


@dataclass(frozen=True)
class Steps:
    """The distinct steps of texts in order: ``key`` (the history, its last three bytes dealt and first, and the byte) and
    ``tail`` (the hash of a word that is longer than the history, else 0). Also the step of each position, in the order of the texts."""

    key: np.ndarray
    tail: np.ndarray
    of: np.ndarray
    size: np.ndarray


def distinct_steps(streams: list[bytes]) -> Steps:
    """The steps of the streams; before each lie spaces."""
    before = b" " * _REACH
    data = np.frombuffer(b"".join([x for s in streams for x in (before, s)]), np.uint8)
    size = np.array([len(s) for s in streams], np.int64)
    begin = np.cumsum(size + _REACH) - size
    kept = np.ones(len(data), bool)
    kept[(begin[:, None] - 1 - np.arange(_REACH)).ravel()] = False
    starts = np.flatnonzero(data == _SPACE) + 1
    parts, a = [], _REACH
    while a < len(data):
        cut = np.searchsorted(starts, a + _PIECE)
        b = int(starts[cut]) if cut < len(starts) else len(data)
        parts.append(pa.array(_ids(data[a - _REACH : b])[kept[a:b]]))
        a = b
    coded = pa.chunked_array(parts).dictionary_encode()
    ids = coded.chunk(0).dictionary.to_numpy()
    of = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    del parts, coded
    first = np.empty(len(ids), np.int32 if len(of) < 1 << 31 else np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1, dtype=first.dtype)
    at = first + _REACH * (np.searchsorted(np.cumsum(size), first, side="right") + 1)
    history = np.zeros(len(at), np.uint64)
    for back in range(1, _REACH + 1):
        history = history << _U(8) | data[at - back]
    key = (_dealt(history >> _U(24)) << _U(24) | history & _U(0xFFFFFF)) << _U(8) | data[at]
    tail = np.where(ids & _LONG, ids >> _U(8) & _U((1 << 48) - 1), _U(0))
    order = _order(key, tail)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return Steps(key[order], tail[order], rank[of], size)


def _order(key: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The order by key and tail; few keys recur, so tails are sorted only where they do."""
    order = np.argsort(key)
    ordered = key[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if len(same):
        tied = np.union1d(same, same + 1)
        order[tied] = order[tied][np.lexsort((tail[order[tied]], ordered[tied]))]
    return order


def _place(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The history of steps (its last byte highest) and how many bytes of the word lie in it."""
    history = _undealt(key >> _U(32)) << _U(24) | key >> _U(8) & _U(0xFFFFFF)
    place = np.full(len(key), _REACH)
    for back in range(_REACH, 0, -1):
        place[history >> _U(8 * (_REACH - back)) & _U(255) == _SPACE] = back - 1
    return history, place


# --- blobs --------------------------------------------------------------------------------------


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers of eight or four bytes, compressed byte by byte of their places."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _loosened(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _far(key: np.ndarray) -> np.ndarray:
    return _place(key)[1] == _REACH


def _key_blobs(key: np.ndarray, tail: np.ndarray) -> tuple[bytes, bytes]:
    return _squeezed(np.diff(key, prepend=_U(0))), _squeezed(tail[_far(key)])


def _blob_keys(keys: bytes, tails: bytes) -> tuple[np.ndarray, np.ndarray]:
    key = np.cumsum(_loosened(keys, np.uint64), dtype=np.uint64)
    tail = np.zeros(len(key), np.uint64)
    tail[_far(key)] = _loosened(tails, np.uint64)
    return key, tail


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]
    release()


# --- chunks of texts, buckets of steps ----------------------------------------------------------

_CHUNKS = "chunk long, bytes long, data binary"
_ASKED = "bucket long, chunk long, keys binary, tails binary, times binary"
_STEPS = "bucket long, keys binary, tails binary, times binary, chunks binary, sizes binary, members binary, words long, tokens long"
_HELD = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("words", pa.int64()), ("stream", pa.binary())])


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of documents as they lie in their partitions, as compressed streams."""
    train = F.coalesce(id_bucket("doc_id", 5) != 1, F.lit(True)).alias("train")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train, F.col("text").cast("binary").alias("text"))

    def packed(number: int, held: list[tuple], size: int) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _HELD, strict=True)], schema=_HELD)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        return _table(_CHUNKS, [(number, size, sink.getvalue().to_pybytes())]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                for doc_id, known, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    said, words = stream(text)
                    if held and size + len(said) > chunk_bytes:
                        yield packed(number, held, size)
                        number, held, size = number + 1, [], 0
                    held.append((doc_id, known, words, said))
                    size += len(said)
        if held:
            yield packed(number, held, size)
        release()

    return texts.mapInArrow(run, _CHUNKS)


def _held(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as rows:
        return rows.read_next_batch()


def _bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key in order, by its last three bytes, and where buckets begin and end."""
    bucket = ((key >> _U(32)) * _U(buckets) >> _U(24)).astype(np.int64)
    return bucket, np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))


def _asked_steps(chunks: DataFrame, buckets: int) -> DataFrame:
    """A chunk's distinct steps with their training counts, sent to the steps' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            held = _held(row["data"])
            steps = distinct_steps(held.column("stream").to_pylist())
            times = np.bincount(steps.of[np.repeat(np.asarray(held.column("train").to_numpy(zero_copy_only=False), bool), steps.size)], minlength=len(steps.key))
            bucket, cuts = _bucket(steps.key, buckets)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found = (int(bucket[a]), row["chunk"], *_key_blobs(steps.key[a:b], steps.tail[a:b]), _squeezed(times[a:b].astype(np.int64)))
                yield _table(_ASKED, [found]).to_batches()[0]

    return chunks.mapInArrow(run, _ASKED)


def _merged_steps(asked: DataFrame) -> DataFrame:
    """One row per bucket: its distinct steps with their training counts, and which of these each chunk holds.

    ``words`` are its distinct training words of at least ``_SHORT`` bytes, ``tokens`` the training tokens that end in it.
    """

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        parts = [_blob_keys(r["keys"], r["tails"]) for r in rows]
        key, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = np.array([len(k) for k, _ in parts], np.int64)
        order = _order(key, tail)
        new = (np.diff(key[order], prepend=~key[order[0]]) != 0) | (np.diff(tail[order], prepend=_U(0)) != 0)
        begin = np.flatnonzero(new)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        times = np.add.reduceat(np.concatenate([_loosened(r["times"], np.int64) for r in rows])[order], begin)
        key, tail = key[order[begin]], tail[order[begin]]
        # a chunk's steps lie in order, so they are told by their distances
        ends = np.cumsum(sizes)
        members = np.diff(of, prepend=0)
        members[ends[:-1]] = of[ends[:-1]]
        ended = key & _U(255) == _SPACE
        known = ended & (times > 0)
        words = len(np.unique(_word_pairs(key[known], tail[known])[1]))
        row = (
            table.column("bucket")[0].as_py(), *_key_blobs(key, tail), _squeezed(times), _squeezed(np.array([r["chunk"] for r in rows], np.int64)),
            _squeezed(sizes), _squeezed(members), words, int(times[ended].sum()),
        )
        return _table(_STEPS, [row])

    return asked.groupBy("bucket").applyInArrow(merge, _STEPS)


# --- counts -------------------------------------------------------------------------------------


def _word_pairs(key: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which steps have a word so far of at least ``_SHORT`` bytes, and numbers of that word and the byte: 54 hashed bits and 8."""
    history, place = _place(key)
    some = np.flatnonzero(place >= _SHORT)
    inside = history[some] >> (8 * (_REACH - place[some])).astype(np.uint64)
    word = mix64(mix64(tail[some] | place[some].astype(np.uint64) << _U(52)) ^ inside)
    return some, (word >> _U(10) << _U(8) | key[some] & _U(255)).astype(np.int64)


def _low_pairs(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which steps have the context, and numbers of context and byte: one byte, two bytes, and words of less than ``_SHORT`` bytes.

    There are at most 2^24 pairs of two bytes and a third, so a table of them does not grow with the input beyond that.
    """
    history, place = _place(key)
    byte = key & _U(255)
    few = np.flatnonzero(place < _SHORT)
    inside = (history[few] >> (8 * (_REACH - place[few])).astype(np.uint64)) * (place[few] > 0)
    every = np.arange(len(key))
    pair = lambda kind, context, byte: ((_U(kind) << _U(16) | context) << _U(8) | byte).astype(np.int64)
    word = pair(0, inside, byte[few]) | (place[few] + 2) << 24
    return [(every, pair(0, history >> _U(40), byte)), (every, pair(1, history >> _U(32), byte)), (few, word)]


@dataclass(frozen=True)
class LowCounts:
    """Pairs of a short context and a byte in order, and the counts of the context's bytes that share its leading bits."""

    key: np.ndarray
    levels: np.ndarray

    def own(self, key: int) -> int:
        """The count of one pair."""
        at = int(np.searchsorted(self.key, key))
        return int(self.levels[at, 8]) if at < len(self.key) and self.key[at] == key else 0

    @cached_property
    def words(self) -> int:
        """Distinct training words among the pairs."""
        return int(((self.key >> 24 > 2) & (self.key & 255 == _SPACE) & (self.levels[:, 8] > 0)).sum())


_END_PAIR = 2 << 24 | _SPACE


def _low_counts(steps: DataFrame) -> LowCounts:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            key, _ = _blob_keys(row["keys"], row["tails"])
            times = _loosened(row["times"], np.int64)
            for some, pair in _low_pairs(key):
                found, at = np.unique(pair, return_inverse=True)
                count = np.bincount(at, times[some], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"key": found, "n": count})

    found = steps.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    key = found.column("key").to_numpy()
    return LowCounts(key, _at_levels(key, found.column("n").to_numpy()))


class CountedSteps:
    """A bucket's steps with the training counts along the bits of their bytes, of every context."""

    def __init__(self, row: dict, low: LowCounts):
        self.key, self.tail = _blob_keys(row["keys"], row["tails"])
        self.times = _loosened(row["times"], np.int64)
        self.symbols = (self.key & _U(255)).astype(np.int64)
        byte = self.key & _U(255)
        one, two, (few, short) = _low_pairs(self.key)
        some, word = _word_pairs(self.key, self.tail)
        self.at = [np.searchsorted(low.key, one[1]), np.searchsorted(low.key, two[1])]
        self.levels = [low.levels, low.levels]
        for shift in (32, 24, 8):
            self._add((self.key >> _U(shift) << _U(8) | byte).astype(np.int64), self.times)
        self._add(word, self.times[some])
        at = np.empty(len(self.key), np.int64)
        at[some], at[few] = self.at[-1] + len(low.key), np.searchsorted(low.key, short)
        self.at[-1], self.levels[-1] = at, np.concatenate([low.levels, self.levels[-1]])

    def _add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        found, at = np.unique(pairs, return_inverse=True)
        self.at.append(at)
        self.levels.append(_at_levels(found, np.bincount(at, times, minlength=len(found)).astype(np.int64)))

    def word_counts(self) -> np.ndarray:
        """How often the word so far was followed by the byte: of a space, the count of the word."""
        return self.levels[-1][self.at[-1], 8]

    def inputs(self, left_out: bool) -> Inputs:
        return Inputs(self, left_out)


class Inputs:
    """What the contexts say of the bits of steps' bytes; ``left_out`` takes away the occurrence that is predicted."""

    def __init__(self, steps: CountedSteps, left_out: bool):
        self.steps, self.stretched, self.seen = steps, [], []
        for k, levels in enumerate(steps.levels):
            upto = np.maximum(levels - 1, 0) if left_out else levels
            same = upto[:, 1:]
            this, other = same.astype(np.float32), (upto[:, :-1] - same).astype(np.float32)
            self.stretched.append(np.log((this + np.float32(0.4)) / (other + np.float32(0.4))))
            self.seen.append(_LEVEL[np.minimum(upto[:, :-1], len(_LEVEL) - 1)] if k >= _K - 2 else None)

    def of(self, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """For the eight bits of each step: each context's log odds of the bit that comes, and which weights mix them."""
        at = [x[some] for x in self.steps.at]
        gate = self.seen[-1][at[-1]] * 8 + self.seen[-2][at[-2]]
        return np.stack([t[i] for t, i in zip(self.stretched, at, strict=True)]), gate


# --- the mixer ----------------------------------------------------------------------------------

#: How often a context was seen, in eight levels.
_LEVEL = np.searchsorted([0.5, 1.5, 2.5, 4.5, 8.5, 16.5, 64.5], np.arange(66)).astype(np.int16)


def _bits(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of a byte: the nodes (leading bits after a one) and the bits."""
    j = np.arange(8)
    return 1 << j | symbols[:, None] >> 8 - j, symbols[:, None] >> 7 - j & 1


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(gate.shape)
    for k in range(_K):
        total += x[k] * weights[:, k][gate]
    return total


def _refined_cells(node: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell below a mixed prediction in the refinement table, and its share of the next."""
    scaled = (np.clip(x, -8, 8) + 8) * ((_BUCKETS - 1) / 16)
    low = np.minimum(scaled.astype(np.int64), _BUCKETS - 2)
    return node * _BUCKETS + low, scaled - low


@dataclass(frozen=True)
class ContextMixer:
    """Weights by gate, and the refinement table. Counts of contexts are no part of it: steps come with theirs."""

    weights: np.ndarray
    refined: np.ndarray

    def scores(self, steps: CountedSteps) -> np.ndarray:
        """log10 probability of each step's byte."""
        out, inputs = np.empty(len(steps.key)), steps.inputs(False)
        for at in range(0, len(out), _SCORED):
            some = slice(at, at + _SCORED)
            node, bit = _bits(steps.symbols[some])
            x = _mixed(*inputs.of(some), self.weights) * (2 * bit - 1)
            cell, share = _refined_cells(node, x)
            p = 0.5 * _squash(x) + 0.5 * (self.refined[cell] * (1 - share) + self.refined[cell + 1] * share)
            out[some] = np.log10(np.where(bit, p, 1 - p)).sum(axis=1)
        return out


def mix_online(steps: CountedSteps, rate: float) -> tuple[np.ndarray, int]:
    """One online pass: each small batch of steps is predicted without itself, then moves the weights of its gates."""
    weights, inputs = np.full((_GATES, _K), 0.3), steps.inputs(True)
    order = np.flatnonzero(steps.times)
    order = order[np.argsort(mix64(steps.key[order] ^ steps.tail[order]))]
    for seen, at in enumerate(range(0, len(order), _MOVED)):
        some = order[at : at + _MOVED]
        times = np.repeat(steps.times[some], 8).astype(np.float64)
        x, gate = inputs.of(some)
        error = (1 - _squash(_mixed(x, gate, weights))).ravel() * times
        gate = gate.ravel()
        mass = np.bincount(gate, times, minlength=_GATES)
        step = rate / np.sqrt(1 + seen / 20) / (mass + 50.0)
        for k in range(_K):
            weights[:, k] += step * np.bincount(gate, error * x[k].ravel(), minlength=_GATES)
    return weights, len(order)


def refine(steps: CountedSteps, weights: np.ndarray, total: np.ndarray) -> None:
    """Add what happened (ones, all) to the cells of the refinement table."""
    order, inputs = np.flatnonzero(steps.times), steps.inputs(True)
    for at in range(0, len(order), _SCORED):
        some = order[at : at + _SCORED]
        node, bit = _bits(steps.symbols[some])
        cell, share = _refined_cells(node, _mixed(*inputs.of(some), weights) * (2 * bit - 1))
        times = steps.times[some][:, None]
        for c, w in ((cell, times * (1 - share)), (cell + 1, times * share)):
            total[0] += np.bincount(c.ravel(), (w * bit).ravel(), minlength=total.shape[1])
            total[1] += np.bincount(c.ravel(), w.ravel(), minlength=total.shape[1])


def finish_refinement(cells: np.ndarray) -> np.ndarray:
    centre = _squash(np.tile(np.linspace(-8, 8, _BUCKETS), 256))
    return np.clip((cells[0] + 4 * centre) / (cells[1] + 4), 1e-6, 1 - 1e-6)


def fit_mixer(steps: DataFrame, low: Broadcast, rate: float = 1.0) -> ContextMixer:
    """Learn from buckets of steps.

    Weights are learnt in an online pass over each bucket's training steps, averaged over buckets by
    their steps, and a second pass counts the refinement. Both passes predict each occurrence without itself.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(_GATES * _K + 1)
        for row in _rows(batches):
            weights, mass = mix_online(CountedSteps(row, low.value), rate)
            total += np.append(weights.ravel() * mass, mass)
        return total if total[-1] else None

    learnt = partition_sums(steps, learn)
    weights = np.full((_GATES, _K), 0.3) if learnt is None else (learnt[:-1] / learnt[-1]).reshape(_GATES, _K)

    def cells(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, 256 * _BUCKETS))
        for row in _rows(batches):
            refine(CountedSteps(row, low.value), weights, total)
        return total.ravel()

    happened = partition_sums(steps, cells)
    happened = np.zeros((2, 256 * _BUCKETS)) if happened is None else happened.reshape(2, -1)
    return ContextMixer(weights, finish_refinement(happened))


@dataclass(frozen=True)
class Learnt:
    """Chunks of texts, buckets of their steps, and the model of the training ones: counts, mixer, training tokens and distinct ones."""

    chunks: DataFrame
    steps: DataFrame
    buckets: int
    low: Broadcast
    mixer: ContextMixer
    tokens: int
    distinct: int


def learn_texts(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> Learnt:
    chunks = cut_lineage(_chunked(spread(docs), group_bytes))
    buckets = max(12, -(-(chunks.agg(F.sum("bytes")).first()[0] or 0) // group_bytes))
    steps = cut_lineage(_merged_steps(_asked_steps(chunks, buckets)))
    totals = steps.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    counts = _low_counts(steps)
    low = docs.sparkSession.sparkContext.broadcast(counts)
    distinct = (totals["words"] or 0) + counts.words + (counts.own(_END_PAIR) > 0)
    return Learnt(chunks, steps, buckets, low, fit_mixer(steps, low), totals["tokens"] or 0, distinct)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every whole text's log10 probability under the mixer and under smoothed word counts.

    Columns: ``doc_id``, ``held_out`` (crc32(doc_id as text) modulo 5 is 1; those texts are not learnt from), ``n_tokens``
    (words and one end), ``n_known`` (tokens that occur in training), ``train_tokens``, ``base_score``, ``score``,
    ``bits_per_byte``. A text is read as its words with A-Z in lower case, each followed by a space, and a space as the end;
    ``score`` is the sum over all bits of these bytes in their order. A null text counts as empty: it is one end. Rows without an
    id are learnt from; repeated rows count and are scored each; other columns are ignored; an empty table gives no rows.

    Steps are dealt by their last three bytes, so that what contexts of three and more bytes count lies in one bucket. Only the counts
    of shorter contexts, which are bounded, and the weights go to all tasks; scores come back to a chunk by a shuffle.
    """
    learnt = learn_texts(docs, group_bytes)
    mixer, low, buckets, tokens = learnt.mixer, learnt.low, learnt.buckets, learnt.tokens
    norm = np.log10(tokens + 0.5 * (learnt.distinct + 1))
    scored = "chunk long, bucket long, scores binary, counts binary"

    def score_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            steps = CountedSteps(row, low.value)
            scores, counts = mixer.scores(steps).astype(np.float32), steps.word_counts()
            members, begin = _loosened(row["members"], np.int64), 0
            for chunk, size in zip(_loosened(row["chunks"], np.int64).tolist(), _loosened(row["sizes"], np.int64).tolist(), strict=True):
                own = np.cumsum(members[begin : (begin := begin + size)])
                ended = own[steps.symbols[own] == _SPACE]
                yield _table(scored, [(chunk, row["bucket"], _squeezed(scores[own]), _squeezed(counts[ended]))]).to_batches()[0]

    answers = learnt.steps.mapInArrow(score_steps, scored)

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        held = _held(chunk.column("data")[0].as_py())
        streams, words = held.column("stream").to_pylist(), np.asarray(held.column("words"))
        steps = distinct_steps(streams)
        answers = answers.sort_by("bucket")
        joined = lambda name, kind: np.concatenate([_loosened(b, kind) for b in answers.column(name).to_pylist()])
        ended = steps.key & _U(255) == _SPACE
        counts = np.zeros(len(ended), np.int64)
        counts[ended] = joined("counts", np.int64)
        # texts and their tokens lie one after another
        total = np.add.reduceat(joined("scores", np.float32).astype(np.float64)[steps.of], np.cumsum(steps.size) - steps.size)
        tokens_of = counts[steps.of[ended[steps.of]]]
        begin = np.cumsum(words + 1) - words - 1
        columns = [
            held.column("doc_id"),
            pa.array(~np.asarray(held.column("train").to_numpy(zero_copy_only=False), bool)),
            pa.array(words + 1),
            pa.array(np.add.reduceat((tokens_of > 0).astype(np.int64), begin)),
            pa.array(np.full(len(words), tokens)),
            pa.array(np.add.reduceat(np.log10(tokens_of + 0.5) - norm, begin)),
            pa.array(total),
            pa.array(-total * np.log2(10) / steps.size),
        ]
        return pa.Table.from_arrays(columns, names=[x.split(" ")[0] for x in SCORED.split(", ")])

    return learnt.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED)
