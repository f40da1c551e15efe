"""The n-gram join, components and vector search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opswatch.llm.components import components
from opswatch.llm.ngram_join import PrefixTree, shingles, similar_components
from opswatch.llm.vector_search import nearest_neighbours, scan, usable


def union(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(7, 200 + i) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(300, edges)
    assert got == {n: want[n] for n in {x for e in edges for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text, n=5):
    table = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    ids = [r[0] for r in rows]
    sets = [grams(r[1]) for r in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    label = union(len(rows), links)
    least = {}
    for i, x in enumerate(label):
        least[x] = min(least.get(x, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[label[i]]) for i in range(len(rows))}


def corpus(seed, families=12, near=10):
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for f in range(families):
        base = [f"f{f}w{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.randrange(1, near)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            rows.append(words + (passage if rng.random() < 0.3 else []))
    rows += [["A", "b"], ["a", "B"], ["solo"], passage, passage[:-1]]
    rng.shuffle(rows)
    return [(10 * i + 3, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("block_sets", [2, 5, 4096])
def test_join_is_exact(make_docs, block_sets):
    """Small blocks divide families over several trees; no link is lost."""
    rows = corpus(block_sets) + [(100_000, None), (100_001, ""), (100_002, "\n "), (100_003, "É x y z"), (100_004, "é x y z")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(make_docs(rows), block_sets=block_sets, bucket_grams=300).collect()}
    assert got == brute(rows)


def test_large_family_over_several_trees(make_docs):
    rng, base = random.Random(5), [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):  # a chain of drift: the ends are not similar, all are connected
        words = list(base)
        for k in range(i // 4):
            words[k * 3 % 120] = f"d{k}"
        words[rng.randrange(120)] = f"r{i}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(make_docs(rows), block_sets=8).collect()}
    assert got == brute(rows)


def test_join_edges(odd_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(odd_docs).collect()}
    assert got[1] == got[2] == (3, 1) and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[-8] == (1, -8)
    assert got[6][0] > 70_000 and got[None][1] is None
    assert similar_components(odd_docs.limit(0)).count() == 0


def test_prefix_tree_links_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(rng.choice(40, rng.integers(1, 25))) for _ in range(25)]
        sizes = np.array([len(s) for s in sets])
        prefixes = sizes - -(-80 * sizes // 100) + 1
        tree = PrefixTree(sizes, prefixes, sets, 80)
        for x in range(len(sets)):
            tree.link(x)
        same = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert tree.label.tolist() == union(25, [(i, j) for i in range(25) for j in range(i) if same(sets[i], sets[j])])


def test_shingles_of_short_texts():
    h = dict((w, i * 7919 + 1) for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f"]))
    assert len(shingles([], 5, h)) == 0 and len(shingles([b"a", b"b"], 5, h)) == 1
    assert len(shingles([b"a", b"b", b"c", b"d", b"e", b"f"], 5, h)) == 2
    assert shingles([b"a", b"b"], 5, h)[0] != shingles([b"b", b"a"], 5, h)[0]


def recall(rows, got, k=10, every=100):
    x = {i: np.array(v, float) for i, v in rows}
    hit = total = 0
    for q in (i for i in x if i % every == 0):
        d = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:k]
        found = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [f[0] for f in found] == list(range(1, len(d) + 1))
        assert all(s == pytest.approx(float(np.sqrt(((x[q] - x[i]) ** 2).sum())), rel=1e-12) for _, i, s in found)
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hit += len({i for _, i in d} & {f[1] for f in found})
        total += len(d)
    return hit / total


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_vector_search(spark, block_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + 0.3 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(700)]  # one very common vector
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=block_rows).collect()
    assert recall(rows, got) >= 0.9
    common = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert [v for _, v in common] == list(range(5000, 5010))


def test_vector_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest_neighbours(df).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert nearest_neighbours(df.limit(0)).count() == 0 and nearest_neighbours(df.where("vec_id = 3")).count() == 0
    assert nearest_neighbours(df.where("vec_id = 0")).count() == 0
    assert df.where(usable(F.col("embedding"))).count() == 6


def test_scan_keeps_ties_and_abandons_only_the_far():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 64))
    v[500:540] = v[0]
    q, rotation = v[[0, 7, 9]], np.linalg.qr(rng.normal(size=(64, 64)))[0]
    which, ids, d = scan(q, np.array([0, 7, 9]), v, np.arange(2000), rotation, 10)
    assert ids[which == 0].tolist() == list(range(500, 510))
    for n, i in ((1, 7), (2, 9)):
        exact = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        exact[i] = np.inf
        assert len(set(np.argsort(exact)[:10]) & set(ids[which == n].tolist())) >= 9
