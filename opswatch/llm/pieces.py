"""Sampled SentencePiece segmentations without replacement, and their decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.llm.common import mix64, release, uniform

#: A public vocabulary of the box; any SentencePiece model file may be given instead.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Bytes of text whose words are segmented together; a longer text is taken alone and whole.
_BYTES = 1 << 19
#: Ids that are decoded together; a longer list is taken alone and whole.
_IDS = 1 << 17
_SPACE_MARK = "▁"  # fixed value: SentencePiece's mark of a space


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: each piece's id and bytes (a space is a space) and the ids of single bytes.

    ``log_prob`` is a Zipf law over the pieces in the vocabulary's order, single bytes last: merge-ordered vocabularies have
    ranks for scores and no probabilities, and none is trained here.
    """

    ids: tuple[int, ...]
    strings: tuple[bytes, ...]
    byte_ids: tuple[int, ...]

    @property
    def log_prob(self) -> tuple[np.ndarray, float]:
        rank = np.log(np.arange(len(self.ids) + 256) + 2.0)
        total = np.log(np.exp(-rank).sum())
        return -rank[: len(self.ids)] - total, float(-rank[-1] - total)


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Read a SentencePiece model with byte fallback; only its list of pieces is used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, strings, byte_ids = [], [], [-1] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids.append(i)
            strings.append(piece.replace(_SPACE_MARK, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no piece for some byte")
    return Pieces(tuple(ids), tuple(strings), tuple(byte_ids))


class _Trie:
    """Dense transitions over the bytes of all pieces; built once in each worker."""

    cached: tuple[int, _Trie] | None = None

    @classmethod
    def of(cls, pieces: Pieces) -> _Trie:
        key = hash((pieces.ids, pieces.strings))
        if cls.cached is None or cls.cached[0] != key:
            cls.cached = (key, cls(pieces))
        return cls.cached[1]

    def __init__(self, pieces: Pieces):
        used = sorted({b for s in pieces.strings for b in s})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        child, piece = {}, [-1]
        for k, s in enumerate(pieces.strings):
            node = 0
            for b in s:
                step = node * width + int(self.kind[b])
                node = child.get(step, 0)
                if not node:
                    node = child[step] = len(piece)
                    piece.append(-1)
            piece[node] = k
        small = np.uint16 if len(piece) < 1 << 16 else np.int32
        self.child = np.zeros(len(piece) * width, small)
        self.child[np.fromiter(child.keys(), np.int64, len(child))] = np.fromiter(child.values(), small, len(child))
        self.piece = np.array(piece, np.int32)
        self.width, self.longest = width, max(map(len, pieces.strings), default=1)
        self.log_prob, self.byte_log_prob = pieces.log_prob
        # words are cut where no piece reaches across
        self.crossing = any(b" " in s.lstrip(b" ") for s in pieces.strings)
        self.newline = any(b"\n" in s for s in pieces.strings)

    def words(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of texts with a space before each, in the order of their first use; all words as their numbers, and each text's count.

        A word is its spaces and what follows up to the next space. Unless a piece holds one, a newline is a word, and spaces before it are another.
        """
        joined = b" " + b" ".join(texts)
        data = np.frombuffer(joined, np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        heads = np.cumsum(size) - size
        begins = np.zeros(len(data), bool)
        if not self.crossing:
            space = data == 32
            begins[1:] = space[1:] & ~space[:-1]
            if not self.newline:
                newline = data == 10
                begins |= newline
                begins[1:] |= newline[:-1]
        begins[heads] = True
        start = np.flatnonzero(begins)
        offsets = np.append(start, len(data))
        cut = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        coded = cut.dictionary_encode()
        counts = np.diff(np.searchsorted(start, heads), append=len(start))
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


class Lattice:
    """All segmentations of distinct words, as edges in one array, with the sampling probability of each edge."""

    def __init__(self, words: pa.Array, trie: _Trie):
        offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
        lengths = np.diff(offsets)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        # most of the time goes into moving these arrays: places and edges are 32-bit numbers where they fit
        index = np.int32 if len(data) * (trie.longest + 2) < 1 << 31 else np.int64
        first = np.flatnonzero((data & 0xC0) != 0x80).astype(index)
        stop = np.repeat(self.end.astype(index), lengths)
        width = np.diff(first, append=len(data))  # bytes of each character
        kinds = trie.kind[data]
        pos, node, depth = first, np.zeros(len(first), np.int64), 0
        begins, ends, labels = [], [], []
        while len(pos):
            inside = pos + depth < stop[pos]
            pos, node = pos[inside], node[inside]
            node = trie.child[node * trie.width + kinds[pos + depth]].astype(np.int64)
            pos, node = pos[node > 0], node[node > 0]
            depth += 1
            hit = trie.piece[node]
            found = hit >= 0
            begins.append(pos[found])
            ends.append(pos[found] + depth)
            labels.append(hit[found])
        # a place's edges stand together, the shortest first: a piece of each length begins at a place at most once
        degree = np.zeros(len(data) + 1, np.int64)
        alone = np.zeros(len(data) + 1, bool)
        step = np.zeros(len(data) + 1, np.int64)
        step[first] = width
        for pos, end in zip(begins, ends, strict=True):
            degree[pos] += 1
            alone[pos[end - pos == step[pos]]] = True
        bare = first[~alone[first]]  # characters without a piece of their own: their bytes, after the other edges
        begins.append(bare)
        ends.append(bare + step[bare])
        labels.append(np.full(len(bare), -1, np.int64))
        degree[bare] += 1
        self.first = np.concatenate([[0], np.cumsum(degree)])  # edges of a place: first[p] to first[p + 1]
        free = self.first[:-1].copy()
        many = int(self.first[-1])
        self.begin, self.edge_end, self.label = np.empty(many, index), np.empty(many, index), np.empty(many, np.int32)
        for pos, end, label in zip(begins, ends, labels, strict=True):
            at = free[pos]
            self.begin[at], self.edge_end[at], self.label[at] = pos, end, label
            free[pos] += 1
        score = np.where(self.label >= 0, trie.log_prob[self.label], trie.byte_log_prob * (self.edge_end - self.begin))
        # from the words' ends to their starts: the log mass of everything that can follow a place; after the last place it stays 0
        follow = np.where(self.edge_end < stop[self.begin], self.edge_end, index(len(data)))
        left = (stop - np.arange(len(data)))[first]
        far = int(left.max()) if len(left) else 0
        order = first[np.argsort(left.astype(np.uint16) if far < 1 << 16 else left, kind="stable")]
        cuts = np.append(0, np.cumsum(np.bincount(left, minlength=far + 1)))
        sorted_degree = degree[order]
        upto = np.append(0, np.cumsum(sorted_degree))
        edges = _ranges(self.first[order], sorted_degree)
        sorted_score, sorted_follow = score[edges], follow[edges]
        del edges
        mass = np.zeros(len(data) + 1)
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            if a < b:
                some = slice(upto[a], upto[b])
                value = sorted_score[some] + mass[sorted_follow[some]]
                mass[order[a:b]] = np.logaddexp.reduceat(value, upto[a:b] - upto[a])
        del sorted_score, sorted_follow
        self.log_p = score + mass[follow] - mass[self.begin]
        self.prob = np.exp(self.log_p)
        running = np.concatenate([[0.0], np.cumsum(self.prob)])
        self.upto = running[1:] - running[self.first[self.begin]]
        self.data = data

    def sample(self, word: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one random way from each place to its word's end, in order, and how many each has."""
        count = np.zeros(len(word), np.int64)
        live = np.flatnonzero(at < self.end[word])
        place, stop = at[live], self.end[word[live]]
        steps = []
        while len(live):
            e, last = self.first[place], self.first[place + 1] - 1
            u = uniform(keys[live] + count[live].astype(np.uint64))
            climbing = np.flatnonzero((u > self.upto[e]) & (e < last))
            while len(climbing):
                e[climbing] += 1
                climbing = climbing[(u[climbing] > self.upto[e[climbing]]) & (e[climbing] < last[climbing])]
            steps.append((live, count[live], e))
            count[live] += 1
            place = self.edge_end[e]
            going = place < stop
            live, place, stop = live[going], place[going], stop[going]
        offset = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for who, nth, e in steps:
            edges[offset[who] + nth] = e
        return edges, count


def _below(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers about ``location``, given that they stay below ``limit``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-limit, np.log(-np.log(u)) - location))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + count[i] - 1, one range after another."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count - start, count)


def sample_segmentations(texts: list[bytes], keys: np.ndarray, k: int, pieces: Pieces) -> list[list[tuple]]:
    """For each text up to ``k`` distinct segmentations, best perturbed value first.

    Each is (ids, log probability, perturbed value, log inclusion probability). The value of a segmentation is its log
    probability plus Gumbel noise; the ``k`` largest are a sample without replacement. They are found top down: a
    node of the search is a beginning of the text's segmentation with all its continuations, its value the largest among
    them, drawn from the mass that the lattice gives it. The best open node is popped; it hands its value to one continuation, drawn
    by mass, and the branches beside that way are opened with values below it (A-star search, whose bound is exact).
    The value that comes next after the last is the threshold of the inclusion probabilities. All texts take a
    step at once; a text with fewer segmentations gives fewer.
    """
    trie = _Trie.of(pieces)
    words, word, counts = trie.words(texts)
    lattice = Lattice(words, trie)
    n = len(texts)
    word_begin = np.cumsum(counts) - counts
    keys = keys.astype(np.uint64)

    def fresh(docs: np.ndarray, from_word: np.ndarray, from_place: np.ndarray, nth: int) -> tuple[np.ndarray, ...]:
        """Continue the texts ``docs`` from a place in one of their words: edges, their words, steps per text."""
        many = word_begin[docs] + counts[docs] - from_word
        tokens = _ranges(from_word, many)
        at = lattice.start[word[tokens]]
        at[np.cumsum(many) - many] = from_place
        owner = np.repeat(np.arange(len(docs)), many)
        with np.errstate(over="ignore"):
            seeds = mix64(mix64(keys[docs][owner] + np.uint64(nth)) + (tokens - word_begin[docs][owner]).astype(np.uint64) * np.uint64(1 << 20))
        edges, each = lattice.sample(word[tokens], at, seeds)
        return edges, np.repeat(tokens, each), np.bincount(owner, each, minlength=len(docs)).astype(np.int64)

    def opened(docs: np.ndarray, edges: np.ndarray, steps: np.ndarray, own_from: np.ndarray, value: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray]:
        """Log mass before each step, and the value of the branches beside it (none before ``own_from``)."""
        begin = np.cumsum(steps) - steps
        log_p = lattice.log_p[edges]
        upto = np.cumsum(log_p)
        base = np.where(begin > 0, upto[begin - 1], 0.0)
        before = upto - log_p - np.repeat(base, steps)
        number = _ranges(np.zeros(len(docs), np.int64), steps)
        # only where another edge begins, and not before ``own_from``, is there anything beside the way
        place = lattice.begin[edges]
        many = lattice.first[place + 1] - lattice.first[place] > 1
        open_at = np.flatnonzero(many & (number >= np.repeat(own_from, steps)))
        of = np.repeat(np.arange(len(docs)), steps)[open_at]
        with np.errstate(divide="ignore"):
            beside = np.log1p(-np.minimum(lattice.prob[edges[open_at]], 1.0))
        u = uniform(mix64(keys[docs][of] + np.uint64((nth + 1) << 32)) + number[open_at].astype(np.uint64))
        v = np.full(len(edges), -np.inf)
        v[open_at] = _below(before[open_at] + beside, value[of], u)
        return before, v

    everyone = np.arange(n)
    value = -np.log(-np.log(uniform(keys, 1)))
    edges, owners, steps = fresh(everyone, word_begin, lattice.start[word[word_begin]], 0)
    before, v = opened(everyone, edges, steps, np.zeros(n, np.int64), value, 0)
    # of every round: texts, edges, words of the edges, steps, mass before, values beside, path value
    paths = [[everyone, edges, owners, steps, before, v, value]]
    row_of = [everyone.copy()]  # of a text its row in each round, -1 where it has none
    pops: list[tuple] = []
    threshold = np.full(n, -np.inf)
    for nth in range(1, k + 1):
        best, best_path, best_step = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        for p, (docs, _, _, st, _, pv, _) in enumerate(paths):
            begin = np.cumsum(st) - st
            top = np.maximum.reduceat(pv, begin)
            where = np.minimum.reduceat(np.where(pv == np.repeat(top, st), np.arange(len(pv)), len(pv)), begin) - begin
            better = top > best[docs]
            best[docs[better]], best_path[docs[better]], best_step[docs[better]] = top[better], p, where[better]
        threshold = best
        docs = np.flatnonzero(best > -np.inf)
        if nth == k or not len(docs):
            break
        from_path, step = best_path[docs], best_step[docs]
        here = np.empty(len(docs), np.int64)  # the popped step's place in its path's arrays
        edge, token, mass = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64), np.empty(len(docs))
        for p, path in enumerate(paths):
            sel = np.flatnonzero(from_path == p)
            rows = row_of[p][docs[sel]]
            here[sel] = (np.cumsum(path[3]) - path[3])[rows] + step[sel]
            edge[sel], token[sel], mass[sel] = path[1][here[sel]], path[2][here[sel]], path[4][here[sel]]
        place = lattice.begin[edge]
        lo, many = lattice.first[place], lattice.first[place + 1] - lattice.first[place]
        choice = np.arange(int(many.max()))[None, :]
        weight = np.where(choice < many[:, None], lattice.prob[np.minimum(lo[:, None] + choice, len(lattice.prob) - 1)], 0.0)
        weight[np.arange(len(docs)), edge - lo] = 0.0
        for old_docs, old_path, old_step, old_choice in pops:
            old = np.full(n, -1)
            old[old_docs] = np.arange(len(old_docs))
            r = old[docs]
            same = np.flatnonzero((r >= 0) & (old_path[r] == from_path) & (old_step[r] == step))
            weight[same, old_choice[r[same]]] = 0.0
        total = weight.sum(axis=1)
        u = uniform(keys[docs], 2, np.full(len(docs), nth)) * total
        chosen = np.minimum((np.cumsum(weight, axis=1) < u[:, None]).sum(axis=1), many - 1)
        chosen = np.where(weight[np.arange(len(docs)), chosen] > 0, chosen, weight.argmax(axis=1))
        taken = weight[np.arange(len(docs)), chosen]
        others = (weight > 0).sum(axis=1) > 1
        with np.errstate(divide="ignore"):
            rest = np.where(others, mass + np.log(np.maximum(total - taken, 0.0)), -np.inf)
        again = _below(rest, best[docs], uniform(keys[docs], 3, np.full(len(docs), nth)))
        for p, path in enumerate(paths):
            sel = np.flatnonzero(from_path == p)
            path[5][here[sel]] = again[sel]
        pops.append((docs, from_path, step, chosen))
        child = lo + chosen
        more, more_words, more_steps = fresh(docs, token, lattice.edge_end[child], nth)
        # the new way: the popped one's steps up to here, the chosen edge, the continuation
        length = step + 1 + more_steps
        begin = np.cumsum(length) - length
        new_edges, new_words = np.empty(int(length.sum()), np.int64), np.empty(int(length.sum()), np.int64)
        for p, path in enumerate(paths):
            sel = np.flatnonzero(from_path == p)
            source, to = _ranges(here[sel] - step[sel], step[sel]), _ranges(begin[sel], step[sel])
            new_edges[to], new_words[to] = path[1][source], path[2][source]
        new_edges[begin + step], new_words[begin + step] = child, token
        to = _ranges(begin + step + 1, more_steps)
        new_edges[to], new_words[to] = more, more_words
        new_before, new_v = opened(docs, new_edges, length, step + 1, best[docs], nth)
        paths.append([docs, new_edges, new_words, length, new_before, new_v, best[docs]])
        rows = np.full(n, -1)
        rows[docs] = np.arange(len(docs))
        row_of.append(rows)

    out: list[list[tuple]] = [[] for _ in range(n)]
    byte_ids, piece_ids = np.array(pieces.byte_ids, np.int32), np.array([*pieces.ids, -1], np.int32)
    for docs, edges, _, steps, before, _, value in paths:
        label, begin_byte = lattice.label[edges], lattice.begin[edges]
        size = np.where(label >= 0, 1, lattice.edge_end[edges] - begin_byte)
        ids = np.repeat(piece_ids[label], size)
        raw = np.flatnonzero(np.repeat(label < 0, size))
        ids[raw] = byte_ids[lattice.data[_ranges(begin_byte[label < 0], size[label < 0])]]
        begin = np.cumsum(steps) - steps
        last = begin + steps - 1
        log_p = before[last] + lattice.log_p[edges[last]]
        per = np.add.reduceat(size, begin)
        gap = log_p - threshold[docs]
        with np.errstate(over="ignore", divide="ignore"):
            log_q = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
        for d, part, lp, g, q in zip(docs.tolist(), np.split(ids, np.cumsum(per)[:-1]), log_p.tolist(), value.tolist(), log_q.tolist(), strict=True):
            out[d].append((part, lp, g, q))
    return out


def decode_bytes(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text whose segmentation ``ids`` is, without the space that was put before it."""
    strings = _strings(pieces)
    return b"".join([strings[i] for i in ids.tolist()])[1:]


def decode_lists(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> pa.Array:
    """``decode_bytes`` of many lists: list i is ``ids[offsets[i] : offsets[i + 1]]``."""
    data, start, size = _joined(pieces)
    begin, count = start[ids], size[ids]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] += 1  # the space before each text
    count[heads] -= 1
    upto = np.append(0, np.cumsum(count))[offsets]
    text = data[_ranges(begin, count)]
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(text)])


_DECODERS: dict[int, list[bytes]] = {}
_JOINED: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _strings(pieces: Pieces) -> list[bytes]:
    key = hash((pieces.ids, pieces.byte_ids))
    if key not in _DECODERS:
        table = [b""] * (max(max(pieces.ids), max(pieces.byte_ids)) + 1)
        for i, s in zip(pieces.ids, pieces.strings, strict=True):
            table[i] = s
        for b, i in enumerate(pieces.byte_ids):
            table[i] = bytes([b])
        _DECODERS[key] = table
    return _DECODERS[key]


def _joined(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, where each id's begin, and how many they are."""
    key = hash((pieces.ids, pieces.byte_ids))
    if key not in _JOINED:
        table = _strings(pieces)
        size = np.array([len(s) for s in table], np.int64)
        _JOINED[key] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size
    return _JOINED[key]


ENCODED = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double, text_crc32 long"


def encode_samples(docs: DataFrame, pieces: Pieces, k: int = SAMPLES, seed: int = 0) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of every whole text.

    Columns: ``doc_id``, ``rank`` (1 has the largest perturbed value), ``ids``, ``log_prob`` (of the
    segmentation given the text), ``perturbed``, ``log_inclusion`` (log probability that a sample above the observed
    threshold holds it), ``text_crc32`` (of the text's UTF-8 bytes, to check decoding). ``doc_id`` seeds the noise, so reruns,
    retries and repeated rows of one id agree. A null text counts as empty; an empty text is the one piece of the space before it,
    with rank 1 only. Rows without an id are seeded as 0; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(pieces)  # the vocabulary: its size is the model's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t.as_py() or b"" for t in batch.column(1)]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < _BYTES):
                    size += len(texts[to])
                    to += 1
                keys = mix64(np.array([i or 0 for i in ids[at:to]], np.int64).astype(np.uint64) + np.uint64(seed))
                found = sample_segmentations(texts[at:to], keys, k, held.value)
                rows = [(i, r, *s, zlib.crc32(t)) for i, t, samples in zip(ids[at:to], texts[at:to], found, strict=True) for r, s in enumerate(samples, 1)]
                doc, rank, part, lp, g, q, crc = zip(*rows, strict=True)
                offsets = np.cumsum([0] + [len(p) for p in part]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(rank, pa.int32()), lists, pa.array(lp), pa.array(g), pa.array(q), pa.array(crc, pa.int64())],
                    names=["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "text_crc32"],
                )
                at = to
                del found, rows, doc, rank, part, lp, g, q, crc, lists
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, ENCODED)


def decode(ids: str | Column, spark: SparkSession, pieces: Pieces) -> Column:
    """Column of the UTF-8 bytes of the text that ``ids`` segments."""
    held = spark.sparkContext.broadcast(pieces)

    def run(lists: pa.Array) -> pa.Array:
        values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        found, at = [pa.array([], pa.binary())], 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _IDS, "right")) - 1)
            found.append(decode_lists(values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], held.value))
            at = to
        return pa.concat_arrays(found)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(ids)
