"""The context mixer against a plain walk over every byte of every text."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from opswatch.llm.context_mixing import distinct_steps, learn_texts, score_texts, stream

LEVELS = [0.5, 1.5, 2.5, 4.5, 8.5, 16.5, 64.5]
DOCS = "doc_id long, text string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def texts():
    rng = random.Random(5)
    words = ["a", "of", "the", "tons", "stone", "stones", "keystones", "whetstones", "a\0b", "é", "Ünder"]
    some = [(i, rng.choice([" ", "\n\t"]).join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(40)]
    return [*some, (40, None), (41, ""), (42, "  The\u00a0END  "), (43, "x" * 300), (43, "x" * 299 + "y"), (None, "no id of the stone"), (3, some[3][1])]


def contexts(said, at):
    """The 1, 2, 3, 4 and 6 bytes before a byte, and its word so far."""
    before = b" " * 6 + said[:at]
    return [*(before[-n:] for n in (1, 2, 3, 4, 6)), (b"word", before[before.rindex(b" ") + 1 :])]


def test_scores_are_those_of_a_walk_over_all_bytes(spark):
    """Contexts reach over words, the counts of all training texts count, and every byte of every text is scored."""
    rows = texts()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    learnt = learn_texts(df, 1 << 10)
    weights, refined = learnt.mixer.weights, learnt.mixer.refined
    seen = Counter()
    for i, text in rows:
        said, _ = stream((text or "").encode())
        for at in range(0 if held(i) else len(said)):
            for k, c in enumerate(contexts(said, at)):
                for j in range(9):
                    seen[k, c, j, said[at] >> 8 - j] += 1

    def score(said):
        total = 0.0
        for at, byte in enumerate(said):
            for j in range(8):
                bit, x, n = byte >> 7 - j & 1, [], []
                for k, c in enumerate(contexts(said, at)):
                    one, zero = (seen[k, c, j + 1, byte >> 8 - j << 1 | b] for b in (1, 0))
                    x.append(math.log((one + 0.4) / (zero + 0.4)))
                    n.append(one + zero)
                gate = int(np.searchsorted(LEVELS, n[5]) * 8 + np.searchsorted(LEVELS, n[4]))
                mixed = float(np.dot(x, weights[gate]))
                scaled = (min(max(mixed, -8), 8) + 8) * 2
                low = min(int(scaled), 31)
                cell, share = (1 << j | byte >> 8 - j) * 33 + low, scaled - low
                p = 0.5 / (1 + math.exp(-mixed)) + 0.5 * (refined[cell] * (1 - share) + refined[cell + 1] * share)
                total += math.log10(p if bit else 1 - p)
        return total

    got = sorted((r["doc_id"] is None, r["doc_id"], r["score"]) for r in score_texts(df, 1 << 10).collect())
    want = sorted((i is None, i, score(stream((t or "").encode())[0])) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-4)
    assert np.abs(weights - 0.3).max() > 0.01


def test_word_order_counts(spark):
    """A text's score is not that of its bag of words."""
    phrase = "small boats carry grain over the quiet river at dawn".split()
    shuffled = random.Random(1).sample(phrase, len(phrase))
    free = [i for i in range(200) if held(i)][:2]
    rows = [(i, " ".join(phrase * 3)) for i in range(100) if not held(i)]
    df = spark.createDataFrame([*rows, (free[0], " ".join(phrase)), (free[1], " ".join(shuffled))], DOCS)
    got = {r["doc_id"]: r for r in score_texts(df).collect()}
    assert got[free[0]]["score"] > got[free[1]]["score"] + 5
    assert got[free[0]]["base_score"] == pytest.approx(got[free[1]]["base_score"])


def test_steps_do_not_depend_on_pieces(monkeypatch):
    streams = [stream((t or "").encode())[0] for _, t in texts()]
    whole = distinct_steps(streams)
    monkeypatch.setattr("opswatch.llm.context_mixing._PIECE", 7)
    cut = distinct_steps(streams)
    for name in ("key", "tail", "of", "size"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    said = [(s[:at][-6:].rjust(6), contexts(s, at)[-1], s[at]) for s in streams for at in range(len(s))]
    assert len(set(said)) == len(whole.key) and len(set(zip(said, whole.of.tolist()))) == len(whole.key)
