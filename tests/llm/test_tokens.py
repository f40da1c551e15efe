"""Tokenizer alignment and byte-level BPE against the public libraries and plain loops."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opswatch.llm.alignment import Tokens, aligned_documents, load_vocabularies, lockstep_cuts
from opswatch.llm.byte_bpe import Encoder, decode_bytes, encode_documents, encoding_digests, load_bpe, merge_alone, merge_together
from tests.llm.conftest import table

ODD = [
    "z" * 5000 + " " * 300 + "\n", "a\x1c b'll don't ՘x 　 語é ▁ x", "<|endoftext|> <s> <0x41> <unk>", "\x00", "aaaaab" * 20,
    "".join(map(chr, range(0x20, 0x500))), "x  y   z \n\n q ", " ", "  ", "naïve▁text", "é ẛﬁ",
]


@pytest.fixture(scope="module")
def bpe():
    return load_bpe()


@pytest.fixture(scope="module")
def library(bpe):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts_encode_as_the_library_does(bpe, library):
    assert [ids.tolist() for ids in Encoder(bpe).encode(ODD)] == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_texts_encode_as_the_library_does(bpe, library, texts):
    assert [ids.tolist() for ids in Encoder(bpe).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_one_tree_and_many_trees_merge_alike(bpe):
    rng = random.Random(5)
    for size in (1, 2, 3, 8, 33, 64):
        words = [bytes(rng.choices(b"abcdeth \xc3\xa9", k=rng.randint(1, size))) for _ in range(40)]
        assert [ids.tolist() for ids in merge_together(words, bpe)] == [merge_alone(w, bpe) for w in words]


def test_encoding_query(spark, odd_docs, bpe, library):
    got = table(encoding_digests(odd_docs, bpe))
    want = []
    for row in odd_docs.collect():
        ids = library.encode_ordinary(row["text"] or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (row["text"] or "").encode())]
        want.append((row["doc_id"], len(ids), *sha))
    assert got == table(spark.createDataFrame(want, "doc_id long, n long, i string, d string"))
    assert table(encoding_digests(odd_docs.limit(0), bpe)) == []


def test_ids_decode_to_the_text(spark, sf, bpe):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    decoded = encode_documents(docs, bpe).select("doc_id", decode_bytes("ids", spark, bpe).cast("string").alias("back"))
    assert docs.count() == decoded.count()
    assert decoded.join(docs, "doc_id").where("back <> coalesce(text, '')").isEmpty()


# --- alignment --------------------------------------------------------------------------------


def brute_alignment(rows):
    """Contract rows by plain loops over (doc_id, text)."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        a_bytes = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        one = a.encode(" " + text, add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        ta, tb = [a_bytes[i] for i in one], [b_bytes(i) for i in two]
        if not text or b"".join(ta) != raw or b"".join(tb) != raw:
            found.append((doc_id, [], [], [], []))
            continue
        a_end, b_end = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
        both = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        groups, links, last = [], [], -1
        for end in both:
            groups.append(
                ",".join(str(i) for i, e in zip(one, a_end) if last < e <= end)
                + "|" + ",".join(str(i) for i, e in zip(two, b_end) if last < e <= end)
            )
            links.append((one[int(np.searchsorted(a_end, end))], two[int(np.searchsorted(b_end, end))]))
            last = end
        counts.update(links)
        found.append((doc_id, one, two, groups, links))
    most = {}
    for (_, i), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (
            doc_id, len(one), len(two), len(groups), len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if one else "",
        )
        for doc_id, one, two, groups, links in found
    ]


_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, sha string"


def test_alignment_of_odd_texts(spark, make_docs, odd_docs):
    docs = odd_docs.where("doc_id is null or doc_id <> 6").union(make_docs([(100 + i, t) for i, t in enumerate(ODD)]))
    docs = docs.repartition(3)
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert table(aligned_documents(docs, load_vocabularies())) == table(spark.createDataFrame(want, _COLUMNS))
    assert table(aligned_documents(docs.limit(0), load_vocabularies())) == []


def test_alignment_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1500]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    assert table(aligned_documents(frame, load_vocabularies())) == table(spark.createDataFrame(brute_alignment(short), _COLUMNS))


def test_segments_leave_the_tokens_of_a_text():
    from opswatch.llm.alignment import Aligner

    text = " ".join(f"word{i % 97}  and\n {i * 7919} don't " for i in range(4000)) + " "
    cut, whole = Aligner(load_vocabularies()), Aligner(load_vocabularies())
    assert cut.breaks
    whole.breaks = False
    for one, other in zip(cut.tokenize([text, *ODD]), whole.tokenize([text, *ODD]), strict=True):
        assert (one is None) == (other is None)
        assert one is None or all(np.array_equal(x, y) for x, y in zip(one, other))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))), max_size=5), st.integers(1, 9))
def test_lanes_find_the_ends_in_common(documents, lane):
    a_ends, b_ends, a_counts, b_counts, base, common = [], [], [], [], 0, []
    for size, one, two in documents:
        one = sorted({e for e in one if e < size} | {size})
        two = sorted({e for e in two if e < size} | {size})
        common += [base + e for e in sorted(set(one) & set(two))]
        a_ends += [base + e for e in one]
        b_ends += [base + e for e in two]
        a_counts.append(len(one))
        b_counts.append(len(two))
        base += size

    def tokens(ends, counts):
        return Tokens(np.zeros(len(ends), np.int32), np.array(ends, np.int64), np.array(counts, np.int64))

    a, b = tokens(a_ends, a_counts), tokens(b_ends, b_counts)
    a_cuts, b_cuts = lockstep_cuts(a, b, lane)
    assert a.ends[a_cuts].tolist() == common == b.ends[b_cuts].tolist()
