"""Similarity join of documents on word n-grams by prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import join_counted, mix64, one_text_per_id, release
from opswatch.llm.components import components
from opswatch.session import cut_lineage

#: n-grams that one task sorts to find those that occur in several documents.
BUCKET_GRAMS = 1_000_000
#: Sets that one prefix tree holds; larger blocks are divided.
BLOCK_SETS = 1024
#: n-grams gathered by a task before they are sent on.
_FLUSH = 1_000_000
_CLASS_BITS = 57  # below the frequency class, so that numeric order is the global order
_KEPT = 40  # bits of a hash that are kept below those of its bucket


class _WordHashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _words(text: bytes | None) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII only: A-Z and the white space 20, 09-0D
    return text.lower().split() if text else []


def shingles(words: list[bytes], n: int, hashes: dict) -> np.ndarray:
    """Hashes of the distinct n-grams in ascending order; fewer words than ``n`` are one n-gram."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(width << 32)) | np.uint64(1)
        total = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            total += h[i : len(h) - width + 1 + i] * factors[i]
    return np.unique(mix64(total))


def _copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``words`` and a digest of the word sequence, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column(1):
                words = _words(text.as_py())
                sizes.append(len(words))
                digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "words", "digest"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, words long, digest binary"
    )


_REQUEST = "bucket long, ids binary, counts binary, low binary, high binary"
_ANSWER = "part long, ids binary, sizes binary, grams binary, classes binary"


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _binary_rows(rows: list[tuple], names: list[str], at_once: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] + [pa.binary()] * (len(names) - 1)
    for at in range(0, len(rows), at_once):
        columns = zip(*rows[at : at + at_once], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _requests(docs: DataFrame, n: int, bits: int, parts: int) -> DataFrame:
    """Each task's n-grams by range of value (bucket), in runs of the documents that own them.

    Of a hash the bucket and the ``_KEPT`` bits below it are sent. Documents and their numbers of n-grams go along
    under negative buckets.
    """
    names = ["bucket", "ids", "counts", "low", "high"]

    def flush(sets: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(s) for s in sets])
        own, keys = np.array(ids, np.int64), np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint32), lengths)
        bucket = (keys >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        keys, owners, bucket = keys[order] >> np.uint64(max(0, 64 - bits - _KEPT)), owners[order], bucket[order]
        low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint8)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] + 1)), len(bucket))
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            start = np.flatnonzero(np.diff(owners[lo:hi].astype(np.int64), prepend=-1))
            counts = np.diff(start, append=hi - lo).astype(np.uint32)
            rows.append((int(bucket[lo]), own[owners[lo:hi][start]].tobytes(), counts.tobytes(), low[lo:hi].tobytes(), high[lo:hi].tobytes()))
        where = _part(own, parts)
        for p in np.unique(where):
            mine = where == p
            rows.append((-1 - int(p), own[mine].tobytes(), lengths[mine].astype(np.uint32).tobytes(), b"", b""))
        yield from _binary_rows(rows, names, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, ids, held = _WordHashes(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                grams = shingles(_words(text.as_py()), n, hashes)
                if len(grams):
                    sets.append(grams)
                    ids.append(doc_id.as_py())
                    held += len(grams)
                if held >= _FLUSH:
                    yield from flush(sets, ids)
                    sets, ids, held = [], [], 0
                    release()
        if sets:
            yield from flush(sets, ids)
        del sets
        hashes.clear()
        release()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _REQUEST)


def _repeated(requests: DataFrame, parts: int) -> DataFrame:
    """Of each bucket's n-grams those in two documents or more, sent to the parts of their documents."""

    def answers(table: pa.Table) -> list[tuple]:
        bucket, rows = table.column("bucket")[0].as_py(), table.to_pylist()
        if bucket < 0:
            return [(-1 - bucket, r["ids"], r["counts"], None, None) for r in rows]
        joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        keys = joined("low", np.uint32) | joined("high", np.uint8).astype(np.uint64) << np.uint64(32)
        ids = np.repeat(joined("ids", np.int64), joined("counts", np.uint32))
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        count = np.diff(start, append=len(keys))
        repeated = np.repeat(count > 1, count)
        level = np.repeat(np.log2(count).astype(np.uint8), count)[repeated]
        grams = keys[repeated] | np.uint64(bucket % (1 << (_CLASS_BITS - _KEPT))) << np.uint64(_KEPT)
        ids = ids[repeated]
        where = _part(ids, parts)
        order = np.argsort(where, kind="stable")
        where, ids, grams, level = where[order], ids[order], grams[order], level[order]
        cuts = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
        return [
            (int(where[lo]), ids[lo:hi].tobytes(), None, grams[lo:hi].tobytes(), level[lo:hi].tobytes())
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)
        ]

    names = ["part", "ids", "sizes", "grams", "classes"]
    schema = pa.schema([("part", pa.int64())] + [(name, pa.binary()) for name in names[1:]])

    def run(table: pa.Table) -> pa.Table:
        answered = pa.Table.from_batches(list(_binary_rows(answers(table), names, 1 << 20)), schema)
        release()
        return answered

    return requests.groupBy("bucket").applyInArrow(run, _ANSWER)


def _ordered_sets(answers: DataFrame, similar: int) -> DataFrame:
    """A row per document: ``size`` of its set, and its repeated n-grams in the global order.

    The order is by frequency class, then value; n-grams of one document come first and cannot match.
    A document whose prefix holds only those links with nothing: its ``grams`` are empty. ``prefix`` is the
    number of repeated n-grams in the prefix of the others.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes, ids, grams, level = {}, [], [], []
        for r in table.to_pylist():
            if r["sizes"] is not None:
                sizes.update(zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["sizes"], np.uint32).tolist(), strict=True))
            else:
                ids.append(np.frombuffer(r["ids"], np.int64))
                grams.append(np.frombuffer(r["grams"], np.uint64))
                level.append(np.frombuffer(r["classes"], np.uint8))
        found = {}
        if ids:
            ids = np.concatenate(ids)
            keys = np.concatenate(level).astype(np.uint64) << np.uint64(_CLASS_BITS) | np.concatenate(grams)
            order = np.lexsort((keys, ids))
            ids, keys = ids[order], keys[order]
            start = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            for lo, hi in zip(start, np.append(start[1:], len(ids)), strict=True):
                size = sizes[int(ids[lo])]
                least = -(-similar * size // 100)  # n-grams that any partner must share
                if hi - lo >= least:
                    found[int(ids[lo])] = (keys[lo:hi].astype(np.int64), (hi - lo) - least + 1)
        names = list(sizes)
        none = np.zeros(0, np.int64)
        lists = [found[d][0] if d in found else none for d in names]
        offsets = np.cumsum([0] + [len(x) for x in lists]).astype(np.int32)
        return pa.Table.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.array([sizes[d] for d in names], pa.int64()),
                pa.array([int(found[d][1]) if d in found else 0 for d in names], pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else none)),
            ],
            names=["doc_id", "size", "prefix", "grams"],
        )

    return answers.groupBy("part").applyInArrow(run, "doc_id long, size long, prefix int, grams array<long>")


class PrefixTree:
    """Ordered n-gram sets as a prefix tree: sorted sequences and the prefixes that neighbours share.

    ``link`` walks it for one set after another. Along the walk the overlap at every depth of the current
    path is kept, so that sets with a common prefix share its count; a branch is left when its overlap and
    what remains of it cannot reach the sets' bound. Pairs that are connected already are not visited.
    """

    def __init__(self, sizes: np.ndarray, prefixes: np.ndarray, grams: list[np.ndarray], similar: int):
        self.n, self.sizes, self.similar = len(grams), sizes.astype(np.int64), similar
        lengths = np.array([len(g) for g in grams])
        values, ranks = np.unique(np.concatenate(grams), return_inverse=True)
        self.sets = np.split(ranks.astype(np.int64), np.cumsum(lengths)[:-1])
        self.order = sorted(range(self.n), key=lambda i: self.sets[i].astype(">u4").tobytes())
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        self.shared = np.zeros(self.n, np.int64)  # length of the prefix shared with the one before
        for k in range(1, self.n):
            a, b = self.sets[self.order[k - 1]], self.sets[self.order[k]]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.shared[k] = differ.argmax() if differ.any() else m
        self.lengths, self.prefixes = lengths, prefixes.astype(np.int64)
        owners = np.repeat(np.arange(self.n), self.prefixes)
        heads = np.concatenate([s[:p] for s, p in zip(self.sets, self.prefixes, strict=True)])
        by = np.argsort(heads, kind="stable")
        self.posting, self.starts = owners[by], np.searchsorted(heads[by], np.arange(len(values) + 1))
        self.mark = np.zeros(len(values), bool)
        self.label = np.arange(self.n)

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        self.label[self.label == max(x, y)] = min(x, y)

    def link(self, x: int) -> None:
        """Connect set ``x`` with every set it is similar to."""
        mine = self.sets[x]
        near = np.unique(np.concatenate([self.posting[self.starts[r] : self.starts[r + 1]] for r in mine[: self.prefixes[x]]]))
        near = near[self.label[near] != self.label[x]]
        low, high = np.minimum(self.sizes[near], self.sizes[x]), np.maximum(self.sizes[near], self.sizes[x])
        near = near[100 * low >= self.similar * high]
        if not len(near):
            return
        self.mark[mine] = True
        depth = np.zeros(int(self.lengths[near].max()) + 1, np.int64)  # overlap at each depth of the path
        at = 0  # the path's place in the sorted sets; its depths up to ``reach`` are counted
        reach = 0
        for k in np.sort(self.place[near]):
            y = self.order[k]
            if self.label[y] == self.label[x]:
                continue
            reach = min(reach, int(self.shared[at + 1 : k + 1].min())) if k > at else reach
            at = k
            # similar when 100 * overlap >= similar * (sizes - overlap)
            need = -(-self.similar * int(self.sizes[x] + self.sizes[y]) // (100 + self.similar))
            if depth[reach] + min(self.lengths[y] - reach, len(mine) - depth[reach]) < need:
                continue
            rest = np.cumsum(self.mark[self.sets[y][reach:]])
            depth[reach + 1 : self.lengths[y] + 1] = depth[reach] + rest
            reach = int(self.lengths[y])
            if depth[reach] >= need:
                self.join(x, y)
        self.mark[mine] = False


def _tree_links(blocks: DataFrame, similar: int) -> DataFrame:
    """Per (block, sub): each set with the least id it is connected to by sets of that tree.

    Rows with ``probe`` are looked up and not held; where there are some, only they are linked.
    Sets whose ``known`` component is the same are not compared.
    """

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        col = {c: np.asarray(table.column(c)) for c in ("doc_id", "size", "prefix", "block", "sub", "known", "probe")}
        order = np.lexsort((col["doc_id"], col["sub"], col["block"]))
        change = np.flatnonzero((np.diff(col["block"][order]) != 0) | (np.diff(col["sub"][order]) != 0)) + 1
        a, b = [], []
        for rows in np.split(order, change):
            if len(rows) < 2:
                continue
            tree = PrefixTree(col["size"][rows], col["prefix"][rows], [values[offsets[i] : offsets[i + 1]] for i in rows], similar)
            known = np.unique(col["known"][rows], return_inverse=True)[1]
            first = np.full(known.max() + 1, len(rows))
            np.minimum.at(first, known, np.arange(len(rows)))
            tree.label = first[known]
            probes = np.flatnonzero(col["probe"][rows])
            for x in probes if len(probes) else range(len(rows)):
                tree.link(int(x))
            a.append(col["doc_id"][rows])
            b.append(col["doc_id"][rows][tree.label])  # rows are in order of id: the first of a label is its least
        none = np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate(a) if a else none), pa.array(np.concatenate(b) if b else none)], names=["a", "b"])

    return blocks.groupBy("bin").applyInArrow(run, "a long, b long")


def _linked(sets: DataFrame, similar: int, block_sets: int) -> DataFrame:
    """``doc_id`` and ``component`` of the sets that are similar to another.

    Sets that share an n-gram of their prefixes, directly or through others, form a block; similar sets are always
    in one block. A block is one prefix tree. A block above ``block_sets`` is dealt over several
    trees, then their components are joined through their least members, and what is then outside the block's largest
    component is looked up in all of its trees: near copies, however many, meet only within trees.
    """
    held = sets.where(F.size("grams") > 0)
    heads = held.select("doc_id", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram"))
    leads = heads.groupBy("gram").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("z")).where("b < z").select("gram", "b")
    edges = heads.join(leads, "gram").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    block_of = cut_lineage(components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("block")))
    block_size = block_of.groupBy("block").count()
    block_of = cut_lineage(block_of.join(block_size, "block").withColumn("subs", F.ceil(F.col("count") / F.lit(block_sets)).cast("int")))
    weight = held.agg(F.sum(F.size("grams"))).first()[0] or 0
    bins = max(16, -(-weight // 500_000))
    sub = F.when(F.col("subs") > 1, F.pmod(F.xxhash64("doc_id"), F.col("subs"))).otherwise(F.lit(0)).cast("int")
    members = held.join(block_of.select("doc_id", "block", "subs"), "doc_id").withColumn("sub", sub)

    def linked(rows: DataFrame) -> DataFrame:
        binned = rows.withColumn("bin", F.pmod(F.xxhash64("block", "sub"), F.lit(bins)))
        return _tree_links(binned.select("bin", "block", "sub", "doc_id", "size", "prefix", "grams", "known", "probe"), similar)

    fresh = (F.col("doc_id").alias("known"), F.lit(False).alias("probe"))
    first = cut_lineage(linked(members.select("*", *fresh)))
    large = block_of.where("subs > 1")
    if large.isEmpty():
        return first.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    # components of one tree are joined through their least members, dealt anew
    heads = first.select(F.col("b").alias("doc_id")).distinct().join(large.select("doc_id"), "doc_id", "left_semi")
    leaders = members.join(heads, "doc_id", "left_semi")
    second = cut_lineage(linked(_dealt(leaders, block_sets).select("*", *fresh)))
    joined = cut_lineage(components(first.union(second)))
    known = joined.select(F.col("node").alias("doc_id"), F.col("component").alias("known"))
    inside = cut_lineage(members.where("subs > 1").select("doc_id", "block", "subs").join(known, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id")))
    sizes = inside.groupBy("block", "known").count()
    largest = sizes.groupBy("block").agg(F.max(F.struct("count", "known"))["known"].alias("main"))
    inside = cut_lineage(inside.join(largest, "block").withColumn("outer", F.col("known") != F.col("main")))
    outside = inside.where("outer").groupBy("block").agg(F.ceil(F.count("*") / F.lit(block_sets)).cast("int").alias("rounds"))
    rows = members.where("subs > 1").join(inside.select("doc_id", "known", "outer"), "doc_id").join(outside, "block")
    turn = F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("turn")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("to")
    base = ("block", "doc_id", "size", "prefix", "grams", "known", "subs")
    own = rows.select(*base, "sub", "rounds", turn, F.lit(False).alias("probe"), "outer")
    own = own.where(~F.col("outer") | (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rounds")) != F.col("turn")))
    probes = rows.where("outer").select(*base, everywhere, "rounds", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rounds")).cast("int").alias("turn"), F.lit(True).alias("probe"), "outer").withColumnRenamed("to", "sub")
    third = own.unionByName(probes).withColumn("sub", (F.col("sub") * F.col("rounds") + F.col("turn")).cast("int"))
    joined = components(first.union(second).union(cut_lineage(linked(third))))
    return joined.select(F.col("node").alias("doc_id"), "component")


def _dealt(leaders: DataFrame, block_sets: int) -> DataFrame:
    """Each block's rows over as many trees as they need."""
    sizes = leaders.groupBy("block").agg(F.ceil(F.count("*") / F.lit(block_sets)).cast("int").alias("_subs"))
    return leaders.join(sizes, "block").withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("_subs")).cast("int")).drop("_subs")


def similar_components(docs: DataFrame, n: int = 5, similar: int = 80, block_sets: int = BLOCK_SETS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a document's set holds its
    distinct ``n``-word shingles, or its whole sequence if it has fewer words. Two documents link
    when ``100 * intersection >= similar * union``; ``component_id`` is the least id reachable by links, the own
    one included. Null texts and texts without words have no shingles and link with nothing. Rows that repeat an
    id are one document with the least of their texts; rows without an id are not compared and have two nulls; other
    columns are ignored; an empty table gives no rows. Texts of equal words are joined once, as one set.

    Shingles are compared by the leading bits of 64-bit hashes: those that choose the bucket and 40 more.
    """
    docs = one_text_per_id(docs)
    named = cut_lineage(_copies(docs))
    total = named.agg(F.sum("words")).first()[0] or 0
    classes = cut_lineage(
        named.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    )
    usable = named.where("digest is not null and doc_id is not null").select("doc_id", "digest")
    others = cut_lineage(join_counted(usable, classes.where("n > 1").select("digest", "rep"), ["digest"], "inner").where("doc_id <> rep").select("doc_id").distinct())
    reps = join_counted(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), others, ["doc_id"], "left_anti", 16)
    bits = max(4, int(np.ceil(np.log2(max(1, total / bucket_grams)))))
    parts = 1 << bits
    sets = cut_lineage(_ordered_sets(_repeated(_requests(reps, n, bits, parts), parts), similar))
    linked = _linked(sets, similar, block_sets)
    found = sets.select("doc_id", "size").join(linked, "doc_id", "left")
    found = classes.join(found.withColumnRenamed("doc_id", "rep"), "rep").select(
        "digest", F.col("size").alias("_size"), F.coalesce("component", "rep").alias("_component")
    )
    return named.join(found, "digest", "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_size", F.lit(0)).cast("long")).alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
    )


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)
"""
