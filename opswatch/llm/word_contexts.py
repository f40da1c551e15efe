"""Counts of the contexts of distinct (class, word) pairs, held by chunks of words and answered by shuffles.

The context mixer no longer reads texts as bags of such pairs. What is left here serves tables of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opswatch.llm.common import mix64

_ORDERS = (1, 2, 3, 0, 5, 0)  # bytes of context inside the word; 0 is all of the word so far
_FREE = 3  # the context that does not hold the text's class
_K = len(_ORDERS)
#: (Class, word) pairs whose contexts one bucket holds, on average.
_PAIRS = 100_000
#: (Class, word) pairs in one task.
_LEARNT = 400_000
_MULT = mix64(np.arange(11, 11 + _K, dtype=np.uint64)) | np.uint64(1)
_BYTE = mix64(np.arange(1 << 10, (1 << 10) + 256, dtype=np.uint64))


def trie_edges(words: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (class, beginning of a word, next byte) triples of ``words``, each ended by a space.

    Returns the contexts' hashes (a row per triple, a column per order), the bytes, the triple of every byte of the ended
    words, and where each word starts among these. What precedes a word is no context, so a triple has one score.
    """
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) + 1 for w in words], np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        each = mix64(_BYTE[data] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        upto = np.cumsum(each) - each
        whole = upto - np.repeat(upto[start], size)
        kind = mix64(np.repeat(classes, size).astype(np.uint64) + np.uint64(1 << 50))
        pair = mix64(whole + kind) + _BYTE[data]
    _, first, pair_of = np.unique(pair, return_index=True, return_inverse=True)
    columns = []
    with np.errstate(over="ignore"):
        for k, order in enumerate(_ORDERS):
            h = (np.full(len(first), np.uint64(order + 1)) + (0 if k == _FREE else kind[first])) * _MULT[k]
            if not order:
                h = mix64(whole[first] + h)
            for back in range(1, order + 1):
                known = place[first] >= back
                h = mix64(h * np.uint64(31) + np.where(known, _BYTE[data[np.maximum(first - back, 0)]], np.uint64(back)))
            columns.append(h)
    return np.stack(columns, axis=1), data[first], pair_of, start


def _bits(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight decisions of a byte: the node (leading bits after a one) and the bit."""
    for j in range(8):
        yield (1 << j) | (symbols.astype(np.int64) >> (8 - j)), (symbols >> (7 - j)) & 1


def _at_levels(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of every counted (context, byte), in order, the sums over its context's bytes that share its 0 to 8 leading bits."""
    out = np.zeros((len(key), 9), np.int64)
    for j in range(9 if len(key) else 0):
        begin = np.flatnonzero(np.diff(key >> (8 - j), prepend=-1))
        out[:, j] = np.repeat(np.add.reduceat(count, begin), np.diff(begin, append=len(key)))
    return out


class Edges:
    """Words' distinct triples (see ``trie_edges``), their distinct contexts in order, and the counts that these were answered."""

    def __init__(self, words: list[bytes], classes: np.ndarray, counts: np.ndarray | None = None):
        contexts, self.symbols, self.pair_of, self.start = trie_edges(words, classes)
        self.contexts, place = np.unique(contexts, return_inverse=True)
        self.place = place.reshape(contexts.shape)
        if counts is not None:
            times = np.repeat(counts, np.diff(self.start, append=len(self.pair_of)))
            self.times = np.bincount(self.pair_of, times, minlength=len(self.symbols))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' own counts: (context's place * 256 + byte) in order, and how often."""
        seen = np.flatnonzero(self.times)
        key, at = np.unique(self.place[seen] * 256 + self.symbols[seen, None], return_inverse=True)
        return key, np.bincount(at.ravel(), np.repeat(self.times[seen], _K), minlength=len(key)).astype(np.int64)

    def answered(self, sizes: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> Edges:
        """Take all training counts of the contexts: how many bytes follow each, these bytes in order, and their counts."""
        self.key = np.repeat(np.arange(len(sizes)), sizes) * 256 + symbols
        self.levels = _at_levels(self.key, counts)
        return self

    def bit_counts(self, some: np.ndarray | slice, left_out: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The eight decisions of triples' bytes: the node, the bit, and each context's zeros and ones at that node.

        ``left_out`` takes away the occurrence that is predicted. A byte that did not follow a context shares its leading bits
        with the next byte above or below that did, so one search finds the counts of all its nodes.
        """
        asked = self.place[some] * 256 + self.symbols[some, None]
        upto = np.zeros((9, *asked.shape), np.int64)
        if len(self.key):
            above = np.searchsorted(self.key, asked)
            for near in (np.minimum(above, len(self.key) - 1), np.maximum(above - 1, 0)):
                key, sums = self.key[near], self.levels[near]
                for j in range(9):
                    upto[j] = np.where(key >> (8 - j) == asked >> (8 - j), sums[..., j], upto[j])
        if left_out:
            upto = np.maximum(upto - 1, 0)
        for j, (node, bit) in enumerate(_bits(self.symbols[some])):
            same, other, one = upto[j + 1], upto[j] - upto[j + 1], bit[:, None] == 1
            yield node, bit, np.where(one, other, same), np.where(one, same, other)


_WORDS = "bucket long, chunk long, words binary, classes binary, counts binary, totals binary, n long, total long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ((),) * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _edges(row: dict) -> Edges:
    return Edges(row["words"].split(b" "), np.frombuffer(row["classes"], np.uint8).astype(np.int64), np.frombuffer(row["counts"], np.int64))

_HISTOGRAMS = "place long, chunk long, contexts binary, sizes binary, symbols binary, counts binary"
_ANSWERED = "chunk long, place long, sizes binary, symbols binary, counts binary"
_WITH_CONTEXTS = "bucket long, chunk long, words binary, classes binary, counts binary, totals binary, sizes binary, symbols binary, seen binary"


def with_contexts(words: DataFrame, pairs: int) -> DataFrame:
    """Each chunk of words with the training counts of the bytes after each of its contexts.

    A chunk sends its distinct contexts, by ranges of their 64-bit hashes, with what its own training words count there. A range
    adds them up and returns to each chunk the counts of its contexts in their order. A context is its own row at any size: what
    grows with the distinct contexts is the number of ranges. Partitions hold what one task learns from.
    """
    ranges = max(12, -(-pairs // _PAIRS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                edges = _edges(row)
                key, count = edges.counted()
                sizes = np.bincount(key >> 8, minlength=len(edges.contexts)).astype(np.uint16)
                symbols = (key & 255).astype(np.uint8)
                place = ((edges.contexts >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
                ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
                rows = [
                    (int(place[a]), row["chunk"], edges.contexts[a:b].tobytes(), sizes[a:b].tobytes(), symbols[ends[a] : ends[b]].tobytes(), count[ends[a] : ends[b]].tobytes())
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                ]
                yield from _table(_HISTOGRAMS, rows).to_batches()

    def add(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in asked), kind)
        contexts, of = np.unique(joined("contexts", np.uint64), return_inverse=True)
        key, at = np.unique(np.repeat(of, joined("sizes", np.uint16)) * 256 + joined("symbols", np.uint8), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, at, joined("counts", np.int64))
        sizes = np.bincount(key >> 8, minlength=len(contexts))
        first = np.cumsum(sizes) - sizes
        symbols = (key & 255).astype(np.uint8)
        rows, begin = [], 0
        for r in asked:
            own = of[begin : (begin := begin + len(r["contexts"]) // 8)]
            n = sizes[own]
            taken = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((r["chunk"], r["place"], n.astype(np.uint16).tobytes(), symbols[taken].tobytes(), count[taken].tobytes()))
        return _table(_ANSWERED, rows)

    def join(word: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("place")
        blobs = [b"".join(answers.column(c).to_pylist()) for c in ("sizes", "symbols", "counts")]
        rows = [(*(r[c] for c in ("bucket", "chunk", "words", "classes", "counts", "totals")), *blobs) for r in word.to_pylist()]
        return _table(_WITH_CONTEXTS, rows)

    tasks = max(2, min(1024, -(-pairs // _LEARNT)))
    answers = words.mapInArrow(ask, _HISTOGRAMS).groupBy("place").applyInArrow(add, _ANSWERED).repartition(tasks, "chunk")
    return words.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, _WITH_CONTEXTS)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Edges]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            blobs = [np.frombuffer(row[c], k) for c, k in (("sizes", np.uint16), ("symbols", np.uint8), ("seen", np.int64))]
            yield row, _edges(row).answered(*blobs)

