"""Stages that keep rows: columns of any name, ids that repeat with other texts."""

import corpus_pipeline
from pyspark.sql import functions as F

from opswatch.llm.exact_dedup import drop_exact_duplicates
from tests.llm.conftest import table

CLASHING = (
    "content_hash _id _hash _n _first _uid _repeat _times _turn key row id digest sha repeat times component_id keep_id "
    "_text _key _chunk _range sid target taken first"
).split()


def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in CLASHING if n not in docs.columns])


def test_columns_of_any_name_come_through(spark, odd_docs):
    docs = clashing(odd_docs)
    plain = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    stages = {"exact": lambda d: drop_exact_duplicates(d)} | {
        n: (lambda d, f=f: f(spark, d, "")) for n, f in corpus_pipeline.STAGES if n in ("exact_dedup", "near_dedup", "mixing")
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}-{r['doc_id']}") for r in rows for n in CLASHING if n not in odd_docs.columns), name
        assert plain(out) == plain(stage(odd_docs)), name


def test_rows_of_one_id_are_judged_by_their_own_text(spark, make_docs):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:-1], "x"])
    other, far = " ".join(f"v{i}" for i in range(60)), " ".join([*(f"v{i}" for i in range(59)), "y"])
    docs = make_docs([(3, " ".join(base)), (5, near), (5, other), (9, far), (9, "alone in the world it is"), (None, near), (7, None)])
    kept = table(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id", "text")
    want = [(3, " ".join(base)), (5, other), (9, "alone in the world it is"), (None, near), (7, None)]
    assert kept == table(spark.createDataFrame(want, "doc_id long, text string"))


def test_texts_whose_hashes_collide_stay(spark, make_docs, monkeypatch):
    from opswatch.llm import exact_dedup

    docs = make_docs([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "a")])
    collide = lambda text: F.substring(F.unhex(F.md5(text)), 1, 0)
    monkeypatch.setattr(exact_dedup.exact_duplicates, "__defaults__", (collide,))
    kept = table(drop_exact_duplicates(docs), "doc_id", "text")
    assert kept == table(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "doc_id long, text string"))


def test_mixing_takes_rows_not_ids(spark, make_docs):
    rows = [(1, " ".join(["w"] * (i + 1)), "s") for i in range(12)] + [(i, "one two three", "a") for i in range(2, 40)]
    docs = make_docs(rows)
    out = corpus_pipeline.mixing(spark, docs, "").groupBy("doc_id", "text").count().collect()
    took = {(r["doc_id"], r["text"]): r["count"] for r in out}
    words = sum(len(t.split()) * n for (_, t), n in took.items())
    total = sum(len(r[1].split()) for r in rows)
    assert abs(words - 1.5 * total) <= 12 + 3 and max(took.values()) == 2
    # rows of id 1 differ in how often they are taken
    assert len({took.get((1, r[1]), 0) for r in rows[:12]}) > 1
