"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from opswatch.llm.alignment import aligned_documents, load_vocabularies
from opswatch.llm.byte_bpe import encoding_digests, load_bpe
from opswatch.llm.common import table
from opswatch.llm.context_mixing import score_texts
from opswatch.llm.exact_dedup import EXACT_DEDUP_SQL, exact_duplicates
from opswatch.llm.licences import scan_licences
from opswatch.llm.mixing import MIXING_SQL, mix_documents
from opswatch.llm.ngram_join import NGRAM_JOIN_SQL, similar_components
from opswatch.llm.pieces import decode, encode_samples, load_pieces
from opswatch.llm.quality import fit_quality, score_quality
from opswatch.llm.sharding import SHARDING_SQL, shard_documents
from opswatch.llm.spelling import SPELLING_SQL, count_words, spelling_variants
from opswatch.llm.toxicity import fit_chain, score_toxicity
from opswatch.llm.vector_search import nearest_neighbours
from opswatch.session import cut_lineage, spread


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39."""
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model of its lines."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth embedding among all of them."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 and 150 % of their words."""
    return mix_documents(table(spark, sf_dir, "documents"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every text under the context mixer and under word counts."""
    return score_texts(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text: their size, weights, a hash of their ids, and whether they decode to it."""
    pieces = load_pieces()
    encoded = encode_samples(table(spark, sf_dir, "documents"), pieces)
    return encoded.select(
        "doc_id", "rank", F.size("ids").alias("n_pieces"), "log_prob", "perturbed", "log_inclusion",
        F.xxhash64("ids").alias("ids_hash"), (F.crc32(decode("ids", spark, pieces)) == F.col("text_crc32")).alias("round_trip"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies: 5-word shingles, Jaccard similarity 0.8."""
    return similar_components(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a chain of categories."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("content_hash")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document; its source and language stand for the directories of its path."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licences(table(spark, sf_dir, "documents"), path)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of two public tokenizers over every text."""
    return aligned_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), load_vocabularies())


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all texts with the commoner word it is a variant of."""
    return spelling_variants(cut_lineage(count_words(table(spark, sf_dir, "documents"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids under a public byte-level vocabulary, and the bytes that they decode to, as digests."""
    return encoding_digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), load_bpe())


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_vector_search": op3_vector_search,
    "op4_mixing": op4_mixing,
    "op5_context_mixing": op5_context_mixing,
    "op6_pieces": op6_pieces,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_licences": op10_licences,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_sharding": SHARDING_SQL,
    "op4_mixing": MIXING_SQL,
    "op7_ngram_join": NGRAM_JOIN_SQL,
    "op9_exact_dedup": EXACT_DEDUP_SQL,
    "op12_spelling": SPELLING_SQL,
}
