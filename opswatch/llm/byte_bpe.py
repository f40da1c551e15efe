"""Byte-level BPE: merges chosen by a segment tree over byte positions, and their decoding."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A public vocabulary of the box; any rank file of the same form may be given instead.
RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text whose distinct matches are merged together; a longer text is taken alone and whole.
_BYTES = 1 << 21
#: Matches up to so many bytes are merged side by side, one tree each in a row of a matrix; longer ones one by one.
_SIDE_BY_SIDE = 64
_LEAVES = 1 << 20
_NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class ByteBpe:
    """The bytes of each id, the pattern whose matches are merged, and characters it takes for another class.

    ``other`` maps characters that the pattern's engine here classes otherwise than the tokenizer's library to one of the same class.
    """

    tokens: tuple[bytes, ...]
    pattern: str
    other: dict[int, str] = field(default_factory=dict, repr=False)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens) if t}

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of all pairs of tokens that merge, and what each becomes: an id, which is its rank too."""
        ids, found = self.ids, {}
        for token, merged in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = merged
        codes = np.array(sorted(found), np.int64)
        return codes, np.array([found[c] for c in codes.tolist()], np.int32)

    @cached_property
    def merged(self) -> dict[int, int]:
        return dict(zip(self.pairs[0].tolist(), self.pairs[1].tolist()))


def load_bpe(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """Read a rank file on the driver; tasks get what it holds, which its vocabulary bounds."""
    import public_tokenizers

    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    tokens = tuple(ranks.get(i, b"") for i in range(max(ranks) + 1))
    return ByteBpe(tokens, pattern or public_tokenizers.PATTERN, _classed_otherwise())


def _classed_otherwise() -> dict[int, str]:
    """Characters that are letters or numbers in one engine's version of Unicode only, as one of the class the library gives them."""
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    theirs, ours = {}, {}
    for kind in "LN":
        encoding = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}+", mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(bytes(encoding.encode_ordinary(every)).decode(), kind)
        ours |= dict.fromkeys("".join(regex.findall(rf"\p{{{kind}}}+", every)), kind)
    stand_in = {"L": "é", "N": "0", None: "†"}
    return {ord(c): stand_in[theirs.get(c)] for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


# --- merging ----------------------------------------------------------------------------------


def merge_alone(word: bytes, bpe: ByteBpe) -> list[int]:
    """The ids of one match: the pair of least rank first, of equal ones the leftmost, until none merges.

    Leaf i of the tree holds the rank of the pair that starts at byte i if a token starts there; a node holds the leftmost leaf of
    its least rank. A merge changes the leaves of the merged token, of the one it took in and of the one before it.
    """
    n = len(word)
    merged = bpe.merged
    token = [int(i) for i in bpe.byte_ids[list(word)]]
    if n < 2:
        return token
    none = int(_NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    rank = [merged.get(a << 32 | b, none) for a, b in zip(token, token[1:])] + [none] * (size - n + 1)
    best = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        left, right = best[2 * node], best[2 * node + 1]
        best[node] = left if rank[left] <= rank[right] else right

    def update(leaf: int, value: int) -> None:
        if rank[leaf] == value:
            return
        rank[leaf] = value
        node = (size + leaf) >> 1
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if rank[left] <= rank[right] else right
            node >>= 1

    while rank[best[1]] != none:
        at = best[1]
        gone = after[at]
        token[at] = rank[at]
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        update(gone, none)
        update(at, merged.get(token[at] << 32 | token[after[at]], none) if after[at] < n else none)
        if before[at] >= 0:
            update(before[at], merged.get(token[before[at]] << 32 | token[at], none))
    out, at = [], 0
    while at < n:
        out.append(token[at])
        at = after[at]
    return out


def _ranks(left: np.ndarray, right: np.ndarray, bpe: ByteBpe) -> np.ndarray:
    codes, becomes = bpe.pairs
    asked = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return np.where(codes[at] == asked, becomes[at], _NONE)


def merge_together(words: list[bytes], bpe: ByteBpe) -> list[np.ndarray]:
    """``merge_alone`` of many matches of at most one power of two bytes: a row of the matrices each, one merge of every row at a time."""
    lengths = np.array([len(w) for w in words])
    size = 1 << int(lengths.max() - 1).bit_length()
    rows, places = len(words), np.arange(size)
    inside = places < lengths[:, None]
    token = np.zeros((rows, size), np.int32)
    token[inside] = bpe.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    alive = inside.copy()
    after = np.tile((places + 1).astype(np.int32), (rows, 1))
    before = np.tile((places - 1).astype(np.int32), (rows, 1))
    rank = np.full((rows, size), _NONE, np.int32)
    paired = places[:-1] + 1 < lengths[:, None]
    rank[:, :-1][paired] = _ranks(token[:, :-1][paired], token[:, 1:][paired], bpe)
    best = np.zeros((rows, 2 * size), np.int32)
    best[:, size:] = places
    level = size // 2
    while level:
        nodes = np.arange(level, 2 * level)
        left, right = best[:, 2 * nodes], best[:, 2 * nodes + 1]
        best[:, nodes] = np.where(np.take_along_axis(rank, left, 1) <= np.take_along_axis(rank, right, 1), left, right)
        level //= 2

    def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        changed = rank[row, leaf] != value
        row, leaf = row[changed], leaf[changed]
        rank[row, leaf] = value[changed]
        node = (size + leaf) >> 1
        for _ in range(size.bit_length() - 1):
            left, right = best[row, 2 * node], best[row, 2 * node + 1]
            best[row, node] = np.where(rank[row, left] <= rank[row, right], left, right)
            node >>= 1

    row = np.arange(rows)
    while True:
        at = best[row, 1]
        merges = rank[row, at] != _NONE
        row, at = row[merges], at[merges]
        if not len(row):
            break
        gone = after[row, at]
        token[row, at] = rank[row, at]
        alive[row, gone] = False
        following = after[row, gone]
        after[row, at] = following
        has = following < lengths[row]
        before[row[has], following[has]] = at[has]
        update(row, gone, np.full(len(row), _NONE, np.int32))
        value = np.full(len(row), _NONE, np.int32)
        value[has] = _ranks(token[row[has], at[has]], token[row[has], following[has]], bpe)
        update(row, at, value)
        prior = before[row, at]
        has = prior >= 0
        behind, prior = row[has], prior[has]
        update(behind, prior, _ranks(token[behind, prior], token[behind, at[has]], bpe))
    flat = token[alive]
    return np.split(flat, np.cumsum(alive.sum(1))[:-1])


def merge_all(words: list[bytes], bpe: ByteBpe) -> list[np.ndarray]:
    """The ids of each of ``words``, those of like length together."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
    sizes: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) <= _SIDE_BY_SIDE:
            sizes.setdefault(max(1, len(word) - 1).bit_length(), []).append(i)
        else:
            out[i] = np.array(merge_alone(word, bpe), np.int32)
    for bits, members in sizes.items():
        rows = _LEAVES >> bits
        for start in range(0, len(members), rows):
            block = members[start : start + rows]
            for i, ids in zip(block, merge_together([words[i] for i in block], bpe)):
                out[i] = ids
    return out


# --- documents --------------------------------------------------------------------------------


class Encoder:
    """Encodes batches of texts; matches that recur in a batch are merged once."""

    def __init__(self, bpe: ByteBpe):
        import regex

        self.bpe, self.pattern = bpe, regex.compile(bpe.pattern)
        self.others = frozenset(map(chr, bpe.other))

    def _matches(self, text: str) -> Iterator[str]:
        if text.isascii() or self.others.isdisjoint(text):
            return map(_whole, self.pattern.finditer(text))
        spans = self.pattern.finditer(text.translate(self.bpe.other))
        return (text[m.start() : m.end()] for m in spans)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        seen: dict[str, int] = {}
        codes = [
            np.fromiter((seen.setdefault(m, len(seen)) for m in self._matches(text)), np.int32)
            for text in texts
        ]
        merged = merge_all([m.encode() for m in seen], self.bpe)
        lengths = np.array([len(ids) for ids in merged], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate(merged) if merged else np.empty(0, np.int32)
        return [flat[ranges(starts[c], lengths[c])] for c in codes]


def _whole(match) -> str:
    return match[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def text_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (null: empty) of runs of rows with at most ``most`` bytes of text, or of one row with more."""
    for batch in batches:
        texts = batch.column(1)
        sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
        start = 0
        while start < len(sizes):
            upto = np.cumsum(sizes[start:])
            stop = start + max(1, int(np.searchsorted(upto, most, side="right")))
            yield batch.column(0).slice(start, stop - start), [t or "" for t in texts.slice(start, stop - start).to_pylist()]
            start = stop


def encode_documents(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, in order; a null or empty text has none.

    One pass without a shuffle; a task holds the texts of one chunk and one tree, or one matrix of trees, of their distinct matches.
    Rows that repeat are encoded each; other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for doc_ids, texts in text_chunks(batches, _BYTES):
            found = encoder.encode(texts)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.concatenate(found).astype(np.int32))
            yield pa.RecordBatch.from_arrays([doc_ids, ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_bytes(ids: str | Column, spark: SparkSession, bpe: ByteBpe) -> Column:
    """The bytes of a column of id arrays; of a null null."""
    shared = spark.sparkContext.broadcast(bpe.tokens)

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        token = shared.value.__getitem__
        return pa.array((None if ids is None else b"".join(map(token, ids.values.to_numpy().tolist())) for ids in lists), pa.binary())

    return run(ids)


def encoding_digests(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: its ids, and the bytes they decode to."""
    encoded = encode_documents(docs, bpe)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode_bytes("ids", docs.sparkSession, bpe), 256).alias("decoded_sha256"),
    )
