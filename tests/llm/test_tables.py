"""Sharding, exact deduplication, mixing: small tables against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opswatch.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from opswatch.llm.mixing import mix_documents
from opswatch.llm.sharding import jump_shards, shard_documents


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 7, 40, 1000])
def test_jump_is_the_published_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 400, 3), *(k * 7919**4 for k in range(50))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = df.select("k", jump_shards(F.col("k"), n).alias("s")).select("k", "s.*").collect()
    assert all((r["shard"], r["grown"]) == (jump(r["k"], n), jump(r["k"], n + 1)) for r in got)


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_sharding(odd_docs, chunk_rows):
    rows = shard_documents(odd_docs, 5, chunk_rows).collect()
    assert len(rows) == 11
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(r["doc_id"] or 0, 5), jump(r["doc_id"] or 0, 6), "key")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert shard_documents(odd_docs.limit(0), 5).count() == 0


def verdicts(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(odd_docs, weak):
    """The weak hash collides for all texts: the bytes decide."""
    hash_of = (lambda t: F.lit(b"0")) if weak else None
    got = (exact_duplicates(odd_docs, hash_of) if weak else exact_duplicates(odd_docs)).collect()
    assert len(got) == 11
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    groups = verdicts(odd_docs)
    assert len(by_sha) == len(groups)
    for text, ids in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in rows)
        assert {r["keep_id"] for r in rows} == {min(known) if known else None}
        assert {r["group_size"] for r in rows} == {len(ids)}
        kept = [r for r in rows if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == (min(known) if known else None)
    assert exact_duplicates(odd_docs.limit(0)).count() == 0


def test_drop_exact_duplicates(odd_docs):
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 5, 6, 7, -8])
    repeated = odd_docs.where("doc_id = 2")
    assert drop_exact_duplicates(repeated).count() == 1
    assert drop_exact_duplicates(odd_docs.limit(0)).count() == 0


def shares(sizes, weights, total):
    """Targets by the rule's own words: give by weight, stop at twice the size, share the excess again."""
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    rest = total
    while open_ and rest > 1e-9:
        w = sum(weights[s] for s in open_)
        give = {s: rest * weights[s] / w for s in open_}
        rest = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("chunk_rows", [5, 2_000])
def test_mixing(make_docs, chunk_rows):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i * i % 11 if i % 3 else 0}") for i in range(900)]
    rows += [(2000 + i, "u v w", None) for i in range(30)] + [(3000, None, "s1"), (3001, " ", "s2"), (3002, "", "empty")]
    docs = make_docs(rows)
    got = mix_documents(docs, chunk_rows=chunk_rows).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = shares(dict(size), {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()))
    source_of, taken = {r[0]: r[2] for r in rows}, Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(taken.values()) == int(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 90 for s in names)
    again = mix_documents(docs.repartition(7), chunk_rows=chunk_rows).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_edges(odd_docs, make_docs):
    got = mix_documents(odd_docs).collect()
    assert len(got) == 11 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix_documents(odd_docs.limit(0)).count() == 0
    assert [r["taken"] for r in mix_documents(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
