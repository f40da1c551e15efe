"""Spelling variants against plain loops."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from opswatch.llm.spelling import SPELLING_SQL, count_words, neighbourhood, reduced, spelling_variants
from tests.llm.conftest import table

_OUT = "word string, form string, root string, n long, n_near long, form_n long"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    form = {}
    near_of = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        near_of[w] = len(near)
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near_of[w], words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("symbols", [1, 6])
def test_variants_are_those_of_all_pairs(spark, symbols):
    rng = random.Random(7)
    words = {}
    for _ in range(60):
        base = "".join(rng.choices("abceéöth", k=rng.randint(1, 8)))
        words[base] = rng.randint(1, 400)
        for _ in range(3):
            at = rng.randrange(len(base) + 1)
            edited = base[:at] + rng.choice(["", "x", "é"]) + base[at + rng.randint(0, 1) :]
            if edited:
                words.setdefault(edited, rng.randint(1, 40))
    frame = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("code", F.lit("x"))
    assert table(spelling_variants(frame, symbols)) == table(spark.createDataFrame(brute(words), _OUT))


def test_chains_of_forms_end_at_one_root(spark):
    words = {"a" * i + "b": 5 ** (9 - i) * 5 for i in range(1, 9)}
    got = {r["word"]: r["root"] for r in spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"ab"}
    ties = spark.createDataFrame([("worded", 50), ("wordee", 50), ("wordéd", 5), ("wordef", 1)], "word string, n long")
    assert table(spelling_variants(ties)) == table(spark.createDataFrame(brute(dict(ties.collect())), _OUT))
    assert table(spelling_variants(ties.limit(0))) == []


def test_neighbourhood_is_full(spark):
    frame = spark.createDataFrame([("ab",)], "w string").select("w", F.explode(F.sequence(F.lit(1), F.length("w") + 1)).alias("at"))
    got = {r[0] for r in frame.select(F.explode(neighbourhood("w", 2))).collect()}
    every = ["".join(x) for n in (1, 2, 3) for x in itertools.product("ab", repeat=n)]
    assert got == {x for x in every if x == "ab" or one_edit("ab", x)}
    coded = frame.select(reduced(F.lit("abcyzÀÿ"), 2)).first()[0]
    assert set(coded) == {"a", "b"} and len(coded) == 7


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_words_of_whole_texts(spark, odd_docs, make_docs, sf):
    many = make_docs([(i, "Wordéd Letters ÀÉletters×÷ letters2letters x_LETTERS abcdeF " * 3) for i in range(300)])
    docs = odd_docs.union(many)
    want = brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert dict(table(count_words(docs))) == want and len(want) > 4
    assert table(count_words(docs.limit(0))) == []
    real = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_words([(r["doc_id"], r["text"]) for r in real.collect()])
    assert dict(table(count_words(real))) == want


def test_sql_agrees_on_odd_rows(spark, odd_docs):
    docs = odd_docs.union(odd_docs).union(odd_docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    found = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({SPELLING_SQL})").fetchall()
    assert table(spelling_variants(count_words(docs))) == table(spark.createDataFrame(found or [], _OUT))
