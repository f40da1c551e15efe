"""Quality, toxicity, language model, segmentation, licences, pipeline."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from opswatch.llm.common import mix64, table as load
from opswatch.llm.context_mixing import _WORDS, _answered, score_texts, with_contexts
from opswatch.llm.licences import TEMPLATES, fit_templates, scan_licences
from opswatch.llm.pieces import Pieces, _Trie, decode, decode_bytes, decode_lists, encode_samples, load_pieces, sample_segmentations
from opswatch.llm.quality import FEATURES, LineModel, fit_quality, forward_backward, keep_quality, line_features, score_quality
from opswatch.llm.toxicity import fit_chain, score_toxicity

BIG = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lines, stay = np.array([1, 4, 2, 6]), np.array([0.7, -0.4])
    e = rng.normal(size=lines.sum()) * 2
    marginal, stays, log_z = forward_backward(e, stay, lines)
    at = 0
    for d, n in enumerate(lines):
        scores, ys = [], list(itertools.product((0, 1), repeat=int(n)))
        for y in ys:
            moves = sum(stay[a] for a, b in zip(y, y[1:]) if a == b)
            scores.append(sum(e[at + i] for i in range(n) if y[i]) + moves)
        z = np.logaddexp.reduce(scores)
        p = np.exp(np.array(scores) - z)
        assert log_z[d] == pytest.approx(z)
        assert marginal[at : at + n] == pytest.approx([sum(q for q, y in zip(p, ys) if y[i]) for i in range(n)])
        for k in (0, 1):
            assert stays[d, k] == pytest.approx(sum(q * sum(a == b == k for a, b in zip(y, y[1:])) for q, y in zip(p, ys)))
        at += n


def test_line_features_by_text():
    texts = ["One two, TWO!\n\nx x x x".encode(), b"", "É\n".encode(), b"a | b\na | b"]
    features, length, lines = line_features(texts)
    assert lines.tolist() == [3, 1, 2, 2] and length.tolist() == [13, 0, 7, 0, 2, 0, 5, 5] and features.shape == (8, FEATURES)
    for i, t in enumerate(texts):  # a text's lines do not depend on its neighbours
        alone, _, _ = line_features([t])
        begin = int(lines[:i].sum())
        assert np.allclose(alone, features[begin : begin + lines[i]])


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, sf, kind):
    docs, labels = load(spark, BIG, "documents"), load(spark, BIG, "labels")
    scored = score_quality(docs, fit_quality(docs, labels)) if kind == "quality" else score_toxicity(docs, fit_chain(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    wrong = [r for r in rows if r["predicted"] != r[kind]]
    assert len(rows) > 80 and len(wrong) <= len(rows) * 0.1
    clean = [r for r in rows if (r["quality"] == 1 if kind == "quality" else r["toxic"] == 0)]
    assert sum(r["predicted"] != r[kind] for r in clean) <= len(clean) * 0.03


def test_models_on_odd_rows(spark, odd_docs, sf):
    labels = load(spark, sf, "labels")
    for scored in (score_quality(odd_docs, fit_quality(odd_docs, labels)), score_toxicity(odd_docs, fit_chain(odd_docs, labels))):
        rows = scored.collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    model = LineModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(3 + 3 * FEATURES), np.zeros(2))
    assert {r["score"] for r in score_quality(odd_docs, model).collect()} == {0.5}
    assert keep_quality(odd_docs, model).count() == 0 and score_quality(odd_docs.limit(0), model).count() == 0
    assert score_toxicity(odd_docs.limit(0), fit_chain(odd_docs, labels.limit(0))).count() == 0


def counted(rows):
    words = lambda t: (t or "").encode().lower().split()
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = Counter(w for i, t in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    return {
        (i, t): (held(i), len(words(t)) + 1, sum(w in train for w in words(t)) + (ends > 0), n, sum(base(train[w]) for w in words(t)) + base(ends))
        for i, t in rows
    }


def test_language_model(spark, odd_docs, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        want = {k[0]: v for k, v in counted([(r["doc_id"], r["text"]) for r in df.collect()]).items()}
        for r in score_texts(df, group_bytes=1 << 17).collect():
            w = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert r["base_score"] == pytest.approx(w[4]) and r["score"] < 0
    assert score_texts(odd_docs).count() == 11 and score_texts(odd_docs.limit(0)).count() == 0


def test_language_model_beats_word_counts(spark, sf):
    rows = score_texts(load(spark, BIG, "documents")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


TINY = Pieces(tuple(range(256, 263)), (b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba"), tuple(range(256)))


def all_ways(text):
    piece, byte = TINY.log_prob
    s, found = b" " + text, {}

    def go(at, ids, score):
        if at == len(s):
            found[tuple(ids)] = score
            return
        alone = False
        for k, p in enumerate(TINY.strings):
            if s.startswith(p, at):
                go(at + len(p), [*ids, TINY.ids[k]], score + piece[k])
                alone |= len(p) == 1
        if not alone:
            go(at + 1, [*ids, s[at]], score + byte)

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(found.values()))
    return {k: v - z for k, v in found.items()}


@pytest.mark.parametrize("text", [b"abab a", b"", b"xab", b"aba\nb  a"])
def test_segmentations_are_drawn_without_replacement(text):
    n, ways = 6000, all_ways(text)
    out = sample_segmentations([text] * n, mix64(np.arange(n, dtype=np.uint64)), 3, TINY)
    first, pair = Counter(), Counter()
    for samples in out:
        keys = [tuple(s[0].tolist()) for s in samples]
        assert len(set(keys)) == len(keys) == min(3, len(ways))
        assert all(ways[k] == pytest.approx(s[1]) for k, s in zip(keys, samples))
        assert [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        assert decode_bytes(samples[0][0], TINY) == text
        first[keys[0]] += 1
        pair[tuple(keys[:2])] += 1
    p = {k: math.exp(v) for k, v in ways.items()}
    assert all(abs(first[k] / n - q) < 0.03 for k, q in p.items())
    if len(p) > 1:
        assert all(abs(pair[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.03 for a in p for b in p if a != b)
    weighed = np.mean([sum(math.exp(s[1] - s[3]) for s in samples) for samples in out])
    assert weighed == pytest.approx(1.0, abs=0.05)  # inclusion probabilities make sums over samples unbiased


def test_lists_decode_together_as_one_by_one():
    rng = np.random.default_rng(5)
    lists = [rng.choice([*TINY.ids, *TINY.byte_ids], n).astype(np.int32) for n in (0, 0, 7, 1, 0, 300, 2, 0)]
    offsets = np.cumsum([0] + [len(x) for x in lists])
    assert decode_lists(np.concatenate(lists), offsets, TINY).to_pylist() == [decode_bytes(x, TINY) for x in lists]
    assert decode_lists(np.empty(0, np.int32), np.zeros(3, np.int64), TINY).to_pylist() == [b"", b""]


def test_encoding_round_trip(spark, odd_docs):
    pieces = load_pieces()
    rows = encode_samples(odd_docs, pieces).withColumn("back", decode("ids", spark, pieces)).collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect())
    assert Counter((r["doc_id"], bytes(r["back"])) for r in rows if r["rank"] == 1) == texts
    again = encode_samples(odd_docs.repartition(3), pieces).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["rank"], r["text_crc32"], tuple(r["ids"])) for r in rs)
    assert key(rows) == key(again)
    assert encode_samples(odd_docs.limit(0), pieces).count() == 0


@pytest.mark.parametrize("extra,pattern", [([], rb" *[^ \n]+|\n| +"), ([b"a\n"], rb"(?s) *[^ ]+| +"), ([b"a b"], rb"(?s).+")])
def test_words_of_many_texts_are_cut_and_numbered_at_once(extra, pattern):
    strings = [b"a", b" b", b"\xc3\xa9", *extra]
    trie = _Trie(Pieces(tuple(range(256, 256 + len(strings))), tuple(strings), tuple(range(256))))
    texts = [b"", b"  ", b"a", b"a  b\n\n c ", b"\n", b" \n a", "\u00e9 \u00e9".encode(), b"a  b", b"x" * 300]
    found = [re.findall(pattern, b" " + t) for t in texts]
    words, coded, counts = trie.words(texts)
    assert counts.tolist() == [len(f) for f in found]
    assert [words[i].as_py() for i in coded.tolist()] == [w for f in found for w in f]
    assert words.to_pylist() == list(dict.fromkeys(w for f in found for w in f))


def test_licences(spark, make_docs):
    mit, gpl, apache = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", TEMPLATES[1][1]
    files = [
        (1, "/repo/LICENSE", mit + "\nplain words of a file\n" * 40), (2, "repo/src/a.py", "nothing here"), (3, "repo/src/deep/b.py", "x\n" + gpl),
        (4, "repo/lib/COPYING.txt", apache), (5, "repo/lib/sub/c.py", None), (6, "other/d.py", "a b"), (7, None, ""), (8, "repo/lib/sub/d.py", "License to the General Public"),
        (8, "repo/lib/sub/d.py", "License to the General Public"), (9, "notes/whole.txt", gpl), (10, "notes/e", "z"),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, p, t in files], "doc_id long, path string, text string, licence string")
    got = sorted((r["doc_id"], r["licence"], r["origin"], r["source_path"]) for r in scan_licences(df).collect() if r["licence"])
    assert got == [
        (1, "MIT", "notice", "repo/LICENSE"), (2, "MIT", "inherited", "repo/LICENSE"), (3, "GPL-3.0", "notice", "repo/src/deep/b.py"),
        (4, "Apache-2.0", "notice", "repo/lib/COPYING.txt"), (5, "Apache-2.0", "inherited", "repo/lib/COPYING.txt"),
        (8, "Apache-2.0", "inherited", "repo/lib/COPYING.txt"), (8, "Apache-2.0", "inherited", "repo/lib/COPYING.txt"),
        (9, "GPL-3.0", "notice", "notes/whole.txt"), (10, "GPL-3.0", "inherited", "notes/whole.txt"),
    ]
    assert scan_licences(df).count() == 11 and scan_licences(df.limit(0)).count() == 0


def test_licence_scan_skips_no_line(spark, sf):
    """The bound that skips lines loses none that the cosine would accept."""
    docs = load(spark, sf, "documents")
    model = fit_templates(docs)
    got = {r["doc_id"] for r in scan_licences(docs.withColumn("path", docs.doc_id.cast("string"))).where("origin = 'notice'").collect()}
    want = {r["doc_id"] for r in docs.collect() if any(model.cosines(x.split()).max() >= 0.8 for x in r["text"].encode().lower().split(b"\n"))}
    assert got == want and want


def test_pipeline_stages(spark, sf):
    labels, docs = load(spark, BIG, "labels"), load(spark, BIG, "documents")
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, BIG)
        out = out.checkpoint() if name != "pieces" else out
        seen[name] = out
        assert name == "pieces" or out.columns == docs.columns
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    ids = lambda n: {r["doc_id"] for r in seen[n].select("doc_id").collect()}
    assert len(good - ids("quality")) <= 0.03 * len(good)
    texts = [" ".join(r["text"].split()) for r in seen["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) and ids("exact_dedup") <= ids("quality")
    assert ids("near_dedup") <= ids("exact_dedup") and ids("mixing") <= ids("near_dedup")
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == ids("mixing")
    assert max(r["count"] for r in seen["mixing"].groupBy("doc_id").count().collect()) == 2


def test_pipeline_on_odd_rows(spark, odd_docs, sf):
    for rows in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() >= 0, name


def test_context_counts_are_exact(spark):
    """Every context has its own counts, however many there are: no two share a slot and none is rounded."""
    rng = np.random.default_rng(1)
    words = sorted({bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(4000)})
    counts, classes = rng.integers(0, 1000, len(words)), rng.integers(0, 3, len(words))
    rows = [(0, c, b" ".join(words[c::4]), bytes(classes[c::4].tolist()), counts[c::4].tobytes(), b"", 0, 0) for c in range(4)]
    want = Counter()
    for word, kind, n in zip(words, classes.tolist(), counts.tolist()):
        for i, byte in enumerate(word + b" "):
            want[kind, word[:i], byte >> 4] += n
    got = with_contexts(spark.createDataFrame(rows, _WORDS), len(words)).toArrow().to_batches()
    seen = 0
    for row, edges in _answered(got):
        levels = [(n0[:, -1], n1[:, -1]) for _, _, n0, n1 in edges.bit_counts(slice(None), False)]
        upto = np.where(edges.symbols >> 4 & 1, levels[3][1], levels[3][0])  # whole beginning, four leading bits
        for w, (word, kind) in enumerate(zip(row["words"].split(b" "), row["classes"])):
            for i, byte in enumerate(word + b" "):
                assert upto[edges.pair_of[edges.start[w] + i]] == want[kind, word[:i], byte >> 4]
                seen += 1
    assert seen == sum(len(w) + 1 for w in words)


def test_wrapped_and_embedded_notices(spark, make_docs):
    """A notice counts over several lines, behind comment marks and inside a longer line; a whole text near a template too."""
    import textwrap

    mit, gpl, bsd = TEMPLATES[6][1], TEMPLATES[9][1], TEMPLATES[15][1]
    wrap = lambda t, mark, n=70: "\n".join(textwrap.wrap(t, n, initial_indent=mark, subsequent_indent=mark))
    code = "\ndef run(values):\n    return [v + 1 for v in values]\n" * 60
    near = " ".join(w for i, w in enumerate(gpl.split()) if i % 3 or w == "3") + " see elsewhere now here some more words of ours besides them all"
    files = [
        (1, "a/LICENSE", "Copyright 2020 Some Body\n\n" + wrap(mit, "") + ", including the rights\nto use" + code), (2, "a/x.py", "nothing"),
        (3, "b/COPYING", wrap(gpl, "# ") + "\n" + code), (4, "b/x.py", "nothing"), (5, "c/x.py", wrap(bsd, " * ", 45) + code),
        (6, "d/x.py", "some words before " * 20 + bsd + " and many words after it" * 20), (7, "e/x.py", code), (8, "f/text", near), (9, "f/x.py", "nothing"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in scan_licences(df).collect()}
    model = fit_templates(df)
    assert not any(model.cosines(x.split()).max() >= 0.8 for f in files for x in f[2].lower().encode().split(b"\n") if f[0] != 6)
    assert 0.5 <= model.cosines(near.lower().encode().split()).max() < 0.8
    assert got == {
        1: ("MIT", "notice"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "notice"), 4: ("GPL-3.0", "inherited"), 5: ("BSD-3-Clause", "notice"),
        6: ("BSD-3-Clause", "notice"), 7: (None, None), 8: ("GPL-3.0", "notice"), 9: ("GPL-3.0", "inherited"),
    }
