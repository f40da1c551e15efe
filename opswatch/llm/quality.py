"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import id_bucket, mix64, release
from opswatch.operators.partition_sums import partition_sums
from opswatch.session import cut_lineage

#: Labelled documents of either class that the model is fitted on, at most; and lines of one of them.
SAMPLE_DOCS = 2_000
SAMPLE_LINES = 1_000
KEEP_FROM = 0.7
#: Bytes of text whose features one call computes.
_BYTES = 1 << 20

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "other": range(128, 256)}
_MARKS = {"stop": b".,;:?", "bang": b"!", "bar": b"|<>{}[]=_\\", "symbol": b"*%&#$@~^+"}


def _table(values) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(values)] = 1
    return out


_COUNTED = [_table(v) for v in (*_KINDS.values(), *_MARKS.values())]
_BLANK = _table((32, 9, 10, 11, 12, 13)).astype(bool)
_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64))
FEATURES = 20


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of numbers about each line of each text, the lines' bytes, and the lines of each text.

    A text has one line more than it has newlines, so an empty one has one line.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    doc_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    doc = np.searchsorted(doc_ends, starts, side="left")
    upper, lower, digit, other, stop, bang, bar, symbol = (np.add.reduceat(t[data], starts) for t in _COUNTED)

    blank = _BLANK[data]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    line_of = np.searchsorted(ends, begins, side="right")
    words = np.bincount(line_of, minlength=len(starts))
    repeated = np.zeros(len(starts))
    fresh = np.zeros(len(starts))
    short = np.zeros(len(starts))
    same_line = np.zeros(len(starts))
    if len(begins):
        # a word's hash: its bytes' hashes, each turned by its place in the word
        sizes = np.diff(begins, append=len(data))
        place = (np.arange(begins[0], len(data)) - np.repeat(begins, sizes)).astype(np.uint64)
        with np.errstate(over="ignore"):
            turned = np.where(blank[begins[0] :], np.uint64(0), _BYTE_HASH[data[begins[0] :]] * (np.uint64(2) * place + np.uint64(1)))
            hashes = np.add.reduceat(turned, begins - begins[0])
            keyed = mix64(hashes + mix64(line_of.astype(np.uint64)))
            line_hash = np.zeros(len(starts), np.uint64)
            np.add.at(line_hash, line_of, mix64(hashes + np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(line_of, line_of).astype(np.uint64)))
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])])
        repeated = np.bincount(line_of, again, minlength=len(starts))
        _, first = np.unique(keyed, return_index=True)
        fresh = np.bincount(line_of[first], minlength=len(starts)).astype(float)
        inside = np.add.reduceat((~blank[begins[0] :]).astype(np.int32), begins - begins[0])
        short = np.bincount(line_of, inside <= 2, minlength=len(starts))
        with np.errstate(over="ignore"):
            doc_line = mix64(line_hash + mix64(doc.astype(np.uint64) + np.uint64(1 << 40)))
        _, back, times = np.unique(doc_line, return_inverse=True, return_counts=True)
        same_line = ((times[back] > 1) & (words > 0)).astype(float)

    n, w, letters = np.maximum(length, 1), np.maximum(words, 1), np.maximum(upper + lower + other, 1)
    last, head = data[np.maximum(ends - 1, starts)], data[starts]
    features = np.stack(
        [
            np.log1p(length) / 8, np.log1p(words) / 6, upper / letters, digit / n, other / n,
            np.minimum(stop / w, 2), np.minimum(bang / w, 2), np.minimum(bar / w, 2), np.minimum(symbol / w, 3),
            np.minimum(letters / w, 30) / 10, repeated / w, 1 - fresh / w, short / w, same_line,
            np.isin(last, list(b".?!")).astype(float), ((head >= 65) & (head <= 90)).astype(float),
            (words < 3).astype(float), (length == 0).astype(float), (upper > 0.5 * letters).astype(float),
            (fresh < 0.5 * words).astype(float),
        ],
        axis=1,
    ).astype(np.float32)
    return features, length, np.bincount(doc, minlength=len(texts))


def with_neighbours(features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its text, and a constant."""
    first = np.zeros(len(features), bool)
    first[np.cumsum(lines) - lines] = True
    final = np.roll(first, -1)
    before = np.where(first[:, None], 0, np.roll(features, 1, axis=0))
    after = np.where(final[:, None], 0, np.roll(features, -1, axis=0))
    edges = np.stack([np.ones(len(features)), first, final], axis=1)
    return np.concatenate([edges, features, before, after], axis=1).astype(np.float64)


def forward_backward(emission: np.ndarray, stay: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals P(good) of all lines, expected stays (bad, good) per text, and log partition per text.

    ``emission`` is the score of good over bad; ``stay`` scores keeping bad and keeping good. Texts are walked side by side,
    the longest first, and scaled line by line, so length costs neither precision nor memory.
    """
    docs, total = len(lines), len(emission)
    begin = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    begin, left = begin[order], lines[order]
    active = np.searchsorted(-left, -np.arange(int(left[0]) if docs else 0), side="left")  # texts with more lines than t
    weight = np.exp(stay)
    shift = np.maximum(emission, 0)
    bad, good = np.exp(-shift), np.exp(emission - shift)
    forward = np.empty((total, 2))
    log_z = np.zeros(docs)
    np.add.at(log_z, np.repeat(np.argsort(order), lines), shift)
    a0 = a1 = None
    for t, n in enumerate(active):
        at = begin[:n] + t
        if t == 0:
            x0, x1 = bad[at], good[at]
        else:
            p0, p1 = a0[:n], a1[:n]
            x0, x1 = (p0 * weight[0] + p1) * bad[at], (p0 + p1 * weight[1]) * good[at]
        scale = x0 + x1
        log_z[:n] += np.log(scale)
        a0, a1 = x0 / scale, x1 / scale
        forward[at, 0], forward[at, 1] = a0, a1
    marginal = np.empty(total)
    stays = np.zeros((docs, 2))
    b0, b1 = np.ones(docs), np.ones(docs)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        m = active[t + 1] if t + 1 < len(active) else 0
        if m:
            following = at[:m] + 1
            e0, e1 = bad[following] * b0[:m], good[following] * b1[:m]
            f0, f1 = forward[at[:m], 0], forward[at[:m], 1]
            both = np.stack([f0 * weight[0] * e0, f0 * e1, f1 * e0, f1 * weight[1] * e1])
            both /= both.sum(axis=0)
            stays[:m, 0] += both[0]
            stays[:m, 1] += both[3]
            n0, n1 = weight[0] * e0 + e1, e0 + weight[1] * e1
            b0[:m], b1[:m] = n0 / (n0 + n1), n1 / (n0 + n1)
        g0, g1 = forward[at, 0] * b0[:n], forward[at, 1] * b1[:n]
        marginal[at] = g1 / (g0 + g1)
    back = np.empty(docs, np.int64)
    back[order] = np.arange(docs)
    return marginal, stays[back], log_z[back]


@dataclass(frozen=True)
class LineModel:
    """Weights of a line's standardised features and of staying bad or good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stay: np.ndarray

    def emission(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return with_neighbours((features - self.mean) / self.scale, lines) @ self.weights

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text: its lines' P(good), weighted by their bytes."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) < _BYTES):
                held += len(texts[to])
                to += 1
            features, length, lines = line_features(texts[at:to])
            marginal, _, _ = forward_backward(self.emission(features, lines), self.stay, lines)
            begin = np.cumsum(lines) - lines
            bytes_ = np.add.reduceat(length, begin)
            even = np.repeat(bytes_ == 0, lines)  # a text of empty lines: all count alike
            weight = np.where(even, 1.0, length)
            out[at:to] = np.add.reduceat(weight * marginal, begin) / np.add.reduceat(weight, begin)
            at = to
        release()
        return np.clip(out, 0.0, 1.0)


def _minimise(evaluate, start: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``evaluate`` gives value and gradient and is one job."""
    x, (value, slope) = start, evaluate(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, used = slope.copy(), []
        for s, y in reversed(pairs):
            a = s @ direction / (s @ y)
            direction -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            direction *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            direction += (a - y @ direction / (s @ y)) * s
        step = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(slope))
        for _ in range(8):
            candidate = x - step * direction
            new_value, new_slope = evaluate(candidate)
            if new_value <= value - 1e-4 * step * (slope @ direction):
                break
            step /= 2
        else:
            return x
        if (new_slope - slope) @ (candidate - x) > 1e-10:
            pairs = [*pairs, (candidate - x, new_slope - slope)][-8:]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        x, value, slope = candidate, new_value, new_slope
        if done:
            break
    return x


def _labelled_lines(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_lines: int) -> DataFrame:
    """Line features of a bounded, hash-ordered sample of labelled documents outside the held-out remainder."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(id_bucket("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by = F.xxhash64("doc_id")
    chosen = [known.where(F.col("quality") == q).orderBy(by, "doc_id").limit(sample_docs) for q in (0, 1)]
    chosen = cut_lineage(chosen[0].union(chosen[1]))  # at most twice sample_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            rows = []
            for text, label in zip(texts, batch.column(0).to_pylist(), strict=True):
                if text.count(b"\n") < sample_lines:
                    features, _, _ = line_features([text])
                    rows.append((label, len(features), features.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                if rows else [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())],
                names=["good", "lines", "features"],
            )

    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut_lineage(joined.select(F.col("quality").cast("int"), "text").mapInArrow(run, "good int, lines int, features binary").coalesce(8))


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES,
    ridge: float = 1e-2, rounds: int = 25,
) -> LineModel:
    """Fit the line model on labelled documents whose crc32(doc_id as text) modulo 4 is not 2.

    Every line of a document takes the document's label. At most ``sample_docs`` documents of either label
    are used, the first by a hash of the id, and none with more than ``sample_lines`` lines. The conditional
    likelihood is summed over partitions, one job per evaluation. Without labels all weights are 0 and every score is 0.5.
    """
    sample = _labelled_lines(docs, labels, sample_docs, sample_lines)

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lines = np.asarray(batch.column("lines")).astype(np.int64)
        features = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
        return np.asarray(batch.column("good")).astype(np.float64), lines, features

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(2 * FEATURES + 3)
        for batch in batches:
            good, lines, features = unpacked(batch)
            x = features.astype(np.float64)
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), good.sum(), len(good)]])
        return total

    sums = partition_sums(sample, moments)
    columns = 3 + 3 * FEATURES
    if sums is None or not 0 < sums[-2] < sums[-1]:
        return LineModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(columns), np.zeros(2))
    mean = sums[:FEATURES] / sums[-3]
    scale = np.sqrt(np.maximum(sums[FEATURES : 2 * FEATURES] / sums[-3] - mean**2, 0)) + 1e-3
    docs_of = {0: sums[-1] - sums[-2], 1: sums[-2]}

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights, stay = theta[:-2], theta[-2:]

        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = np.zeros(len(theta) + 1)
            for batch in batches:
                good, lines, features = unpacked(batch)
                if not len(good):
                    continue
                x = with_neighbours((features - mean) / scale, lines)
                emission = x @ weights
                marginal, stays, log_z = forward_backward(emission, stay, lines)
                share = np.where(good > 0, 0.5 / docs_of[1], 0.5 / docs_of[0]) / lines
                begin = np.cumsum(lines) - lines
                gold = good * (np.add.reduceat(emission, begin) + stay[1] * (lines - 1)) + (1 - good) * stay[0] * (lines - 1)
                each = np.repeat(share, lines)
                total[0] += (share * (log_z - gold)).sum()
                total[1:-2] += x.T @ (each * (marginal - np.repeat(good, lines)))
                total[-2] += (share * (stays[:, 0] - (1 - good) * (lines - 1))).sum()
                total[-1] += (share * (stays[:, 1] - good * (lines - 1))).sum()
            return total

        total = partition_sums(sample, work)
        return total[0] + ridge / 2 * theta @ theta, total[1:] + ridge * theta

    theta = _minimise(evaluate, np.zeros(columns + 2), rounds)
    return LineModel(mean, scale, theta[:-2], theta[-2:])


def score_quality(docs: DataFrame, model: LineModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document, from its text alone.

    A null text counts as empty; an empty one has one empty line and a score like any other. Repeated rows get
    equal scores, a row without an id is not held out, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t.as_py() or b"" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= KEEP_FROM).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: LineModel) -> DataFrame:
    """The documents with a score from ``KEEP_FROM``, with all their columns, in one pass without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            yield batch.filter(pa.array(model.scores(texts) >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)
