"""Alignment of two tokenizations of the same bytes, all documents of a batch advanced in lockstep."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.llm.byte_bpe import ranges, text_chunks
from opswatch.llm.common import BROADCAST_BYTES
from opswatch.session import cut_lineage

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text aligned together; a longer text is taken alone and whole.
_BYTES = 1 << 21
#: Segments that a tokenizer gets at once.
_CALL = 4_096
#: Bytes of distinct segments that a task keeps over its batches.
_KEPT_BYTES = 1 << 24
#: Tokens of the first kind in a lane; longer documents advance in several lanes at once.
_LANE = 256
_MARK = "▁"  # fixed value: SentencePiece's mark of a space
#: Where neither tokenizer merges across: a space after something else, but for one at the very end.
_BREAK = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


@dataclass(frozen=True)
class Vocabularies:
    """Two tokenizers as their files' content, and the bytes of each of their ids."""

    byte_level: str
    pieces: bytes
    a_bytes: tuple[bytes, ...]
    b_bytes: tuple[bytes, ...]


def load_vocabularies(byte_level: str | None = None, pieces: str | None = None) -> Vocabularies:
    """Read a byte-level tokenizer file (A) and a SentencePiece model (B) on the driver; tasks get the contents, which the files bound."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    with open(byte_level or public_tokenizers.path(BYTE_LEVEL), encoding="utf-8") as file:
        a_file = file.read()
    with open(pieces or public_tokenizers.path(PIECES), "rb") as file:
        b_file = file.read()
    a = Tokenizer.from_str(a_file)
    b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    shown = _byte_characters()
    a_bytes = [_unshown(a.id_to_token(i) or "", shown) for i in range(a.get_vocab_size(with_added_tokens=True))]
    b_bytes = []
    for i in range(b.vocab_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(_MARK, " ").encode())
    return Vocabularies(a_file, b_file, tuple(a_bytes), tuple(b_bytes))


def _byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _unshown(token: str, shown: dict[str, int]) -> bytes:
    return bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()


# --- lockstep ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """The tokens of several documents, one after the other: ids, where each ends in their joined bytes, and tokens per document."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def lockstep_cuts(a: Tokens, b: Tokens, lane: int = _LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and of B that end together, in order.

    The documents must have the same bytes under both, and no token may be empty. The state is one row per lane: a pointer into A, one into B, and where
    they stop. Each step compares the ends under all pointers at once, emits those that are equal as cuts, advances the pointer
    that is behind (both at a cut) and drops the lanes that are through. A document is a lane;
    one of more than ``lane`` tokens of A is several, cut at the ends of such tokens, as pairs never reach across an end.
    """
    stops = np.cumsum(a.counts)
    lanes = -(-a.counts // lane)
    first = np.repeat(stops - a.counts, lanes)
    within = np.arange(len(first)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a_at = first + within * lane
    a_stop = np.minimum(a_at + lane, np.repeat(stops, lanes))
    # the first token of B beyond the last end before the lane; the last of the batch ends with A's
    border = np.searchsorted(b.ends, a.ends[a_at[1:] - 1], side="right") if len(a_at) else np.empty(0, np.int64)
    b_at = np.concatenate([np.zeros(min(1, len(a_at)), np.int64), border])
    b_stop = np.append(b_at[1:], len(b.ids))[: len(b_at)]
    cuts_a, cuts_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(a_at):
        a_end, b_end = a.ends[a_at], b.ends[b_at]
        together = a_end == b_end
        cuts_a.append(a_at[together])
        cuts_b.append(b_at[together])
        a_at = a_at + (a_end <= b_end)
        b_at = b_at + (b_end <= a_end)
        on = (a_at < a_stop) & (b_at < b_stop)
        if not on.all():
            a_at, b_at, a_stop, b_stop = a_at[on], b_at[on], a_stop[on], b_stop[on]
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class Segments:
    """Tokenized segments: a number for each, and its ids on either side as a range of one array."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.sides = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))] * 2
        self.exact, self.n_bytes = np.empty(0, bool), 0

    def add(self, side: int, found: list[list[int]]) -> None:
        flat, starts, lengths = self.sides[side]
        more = np.array(list(map(len, found)), np.int64)
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32, int(more.sum()))])
        lengths = np.concatenate([lengths, more])
        self.sides[side] = flat, np.cumsum(lengths) - lengths, lengths


class Aligner:
    """Tokenizes and aligns batches of texts in a task."""

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.pieces)
        self.bytes = vocabularies.a_bytes, vocabularies.b_bytes
        self.kept = Segments()
        self.sizes = tuple(np.array([len(t) for t in tokens], np.int64) for tokens in self.bytes)
        # no piece goes on over a space, so a text may be cut before one
        self.breaks = not any(re.search(rb"[^ ] ", t) for t in vocabularies.b_bytes)

    def segments(self, text: str) -> list[str]:
        """Parts of a text, each from a space on, that both tokenizers treat as they treat the whole."""
        return _BREAK.split(text) if self.breaks else [text]

    def tokenize(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of a space and each text under A, and of the text under B, if both have its bytes; else nothing.

        Words recur, so distinct segments are tokenized once, kept over the batches of a task up to a bound, and put together again.
        """
        if self.kept.n_bytes > _KEPT_BYTES:
            self.kept = Segments()
        kept, known = self.kept, len(self.kept.seen)
        seen = kept.seen
        codes = [np.array([seen.setdefault(s, len(seen)) for s in self.segments(text)], np.int64) for text in texts]
        new = [" " + s for s in islice(reversed(seen), len(seen) - known)][::-1]
        exact = np.ones(len(new), bool)
        for i, found in enumerate((self._encoded_a(new), self._encoded_b(new))):
            tokens = self.bytes[i].__getitem__
            exact &= np.fromiter((b"".join(map(tokens, ids)) == s.encode() for ids, s in zip(found, new)), bool, len(new))
            kept.add(i, found)
        kept.exact = np.concatenate([kept.exact, exact])
        kept.n_bytes += 64 * len(new) + sum(map(len, new))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, code in zip(texts, codes):
            both = tuple(flat[ranges(starts[code], lengths[code])] for flat, starts, lengths in kept.sides)
            whole = kept.exact[code].all() or self._whole(both, (" " + text).encode())
            out.append(both if text and whole else None)
        return out

    def _encoded_a(self, spaced: list[str]) -> list[list[int]]:
        return [
            e.ids
            for start in range(0, len(spaced), _CALL)
            for e in self.a.encode_batch_fast(spaced[start : start + _CALL], add_special_tokens=False)
        ]

    def _encoded_b(self, spaced: list[str]) -> list[list[int]]:
        return self.b.encode([s[1:] for s in spaced], num_threads=1)

    def _whole(self, both: tuple[np.ndarray, np.ndarray], raw: bytes) -> bool:
        return all(b"".join(map(tokens.__getitem__, ids.tolist())) == raw for tokens, ids in zip(self.bytes, both))

    def align(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray] | None], Tokens, Tokens, np.ndarray, np.ndarray]:
        """Ids of each text (None: no tokens), and the tokens and cuts of all texts that have some."""
        found = self.tokenize(texts)
        tokens = []
        for side in (0, 1):
            ids = [pair[side] for pair in found if pair is not None]
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            counts = np.array([len(i) for i in ids], np.int64)
            tokens.append(Tokens(flat, np.cumsum(self.sizes[side][flat]), counts))
        return found, *tokens, *lockstep_cuts(*tokens)


class GroupTexts:
    """Groups as text: ids of A, a bar, ids of B, a semicolon between groups, commas between ids."""

    def __init__(self, sizes: tuple[int, int]):
        self.names = [f"{i}{end}" for i in range(max(sizes)) for end in ",|;"]

    def parts(self, a: Tokens, b: Tokens, a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[int]:
        """What follows what: a number for each token of either side, whose name is the id and what comes after it."""
        a_end, b_end = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        a_end[a_cuts], b_end[b_cuts] = 1, 2
        a_group = np.cumsum(a_end) - a_end
        b_group = (np.cumsum(b_end) - b_end) >> 1
        # before a token of A stand the B tokens of earlier groups, before one of B the A tokens up to its group
        b_before = np.concatenate([[0], b_cuts + 1])
        out = np.empty(len(a.ids) + len(b.ids), np.int64)
        out[np.arange(len(a.ids)) + b_before[a_group]] = a.ids.astype(np.int64) * 3 + a_end
        out[np.arange(len(b.ids)) + (a_cuts + 1)[b_group]] = b.ids.astype(np.int64) * 3 + b_end
        return out.tolist()

    def text(self, parts: list[int]) -> str:
        """The groups of the document with these parts."""
        return "".join(map(self.names.__getitem__, parts))[:-1]


# --- documents --------------------------------------------------------------------------------

_CHUNKS = (
    "chunk long, pairs array<long>, times array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, "
    "n_links array<int>, groups_sha256 array<string>, links binary"
)
_OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _aligned_chunks(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """One row per batch of documents: their digests, their distinct linked id pairs, and each link as a place among these."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        texts_of = GroupTexts((len(aligner.bytes[0]), len(aligner.bytes[1])))
        part = TaskContext.get().partitionId() << 33
        for i, (doc_ids, texts) in enumerate(text_chunks(batches, _BYTES)):
            found, a, b, a_cuts, b_cuts = aligner.align(texts)
            codes = a.ids[a_cuts].astype(np.int64) << 32 | b.ids[b_cuts]
            pairs, places, times = np.unique(codes, return_inverse=True, return_counts=True)
            parts = texts_of.parts(a, b, a_cuts, b_cuts)
            n_a, n_b, n_links, digests = [], [], [], []
            a_from = b_from = cut_from = 0
            for pair in found:
                na, nb = (0, 0) if pair is None else map(len, pair)
                upto = int(np.searchsorted(a_cuts, a_from + na))
                digest = ""
                if na:
                    groups = texts_of.text(parts[a_from + b_from : a_from + b_from + na + nb])
                    digest = hashlib.sha256(groups.encode()).hexdigest()
                n_a.append(na)
                n_b.append(nb)
                n_links.append(upto - cut_from)
                digests.append(digest)
                a_from, b_from, cut_from = a_from + na, b_from + nb, upto
            small = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
            row = {
                "chunk": part + i, "pairs": pairs, "times": times, "doc_id": doc_ids.to_pylist(), "n_a": n_a, "n_b": n_b,
                "n_links": n_links, "groups_sha256": digests, "links": places.astype(small).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], _arrow(_CHUNKS))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _CHUNKS)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        inner = re.fullmatch(r"array<(\w+)>", kind)
        fields.append(pa.field(name, pa.list_(kinds[inner[1]]) if inner else kinds[kind]))
    return pa.schema(fields)


def pair_counts(asked: DataFrame, n_pieces: int) -> DataFrame:
    """``pair, count, best``: how many links hold each id pair, and whether no pair of its B id has more.

    ``asked``: ``pair, times``. At most one row per id of B is broadcast, and only where that many fit.
    """
    totals = asked.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    most = F.broadcast(most) if n_pieces * 64 <= BROADCAST_BYTES else most
    return totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_documents(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """One row per document: its tokens under A and B, the groups between common cuts, and its links under corpus-wide counts.

    Columns: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (of the groups as ``GroupTexts`` writes
    them). A encodes a space and the text, B the text. A link is a token of A and one of B that end together, so each cut is one.
    A null or empty text, or one whose tokens do not have its bytes under A or B, has no tokens: zeros and an empty digest. Repeated
    rows count each; other columns are left out; an empty table gives no rows.

    Texts are read and tokenized once, in batches that are written with the distinct id pairs they link. These pairs are counted over
    all batches (added up per task before the shuffle), and each batch gets the counts of its own pairs back:
    rows grow with the distinct pairs per batch, not with links, and no table of all pairs reaches one task.
    """
    chunks = cut_lineage(_aligned_chunks(docs, vocabularies))
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p"))
    asked = asked.select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = pair_counts(asked, len(vocabularies.b_bytes))
    answers = asked.join(counts, "pair").select(F.col("chunk").alias("to_chunk"), "place", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _arrow(_OUT).empty_table()
        (chunk,) = left.to_pylist()
        counts, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        counts[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy()
        links = np.frombuffer(chunk["links"], np.uint16 if len(counts) <= 1 << 16 else np.uint32)
        stops = np.cumsum(chunk["n_links"])

        def per_document(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values[links])])
            return sums[stops] - sums[stops - chunk["n_links"]]

        found = {
            "doc_id": chunk["doc_id"], "n_a": chunk["n_a"], "n_b": chunk["n_b"],
            "n_groups": chunk["n_links"], "n_links": chunk["n_links"],
            "n_best": per_document(best), "count_sum": per_document(counts), "groups_sha256": chunk["groups_sha256"],
        }
        return pa.table(found, _arrow(_OUT))

    done = chunks.drop("pairs", "times").groupBy("chunk").cogroup(answers.groupBy("to_chunk"))
    return done.applyInArrow(finish, _OUT)
