"""A training corpus from raw documents, in stages that each take the last one's table.

Every stage is a function of (session, documents, folder of the tables). All but the last return the columns of
documents. Stages are written to the shared folder between each other, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.llm.common import join_counted, keyed_rows, table
from opswatch.llm.exact_dedup import drop_exact_duplicates
from opswatch.llm.mixing import mix_documents
from opswatch.llm.ngram_join import similar_components
from opswatch.llm.pieces import encode_samples, load_pieces
from opswatch.llm.quality import fit_quality, keep_quality
from opswatch.session import cut_lineage, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line model, fitted on the labelled ones among them, does not reject."""
    ship_package(spark)
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by a Jaccard similarity of 0.8 of 5-word shingles the one with the smallest id.

    Rows without words or without an id are connected to nothing and stay. Each row is compared by its own text, so rows that share an
    id with another text are judged apart; of equal rows the first stays.
    """
    ship_package(spark)
    rows = keyed_rows(docs)
    known = rows.where("row.doc_id is not null")
    groups = cut_lineage(similar_components(known.select(F.col("key").alias("doc_id"), "row.text")))
    groups = groups.select(F.col("doc_id").alias("key"), "component_id")
    ids = known.select("key", F.col("row.doc_id").alias("id"))
    # only components of several rows have anything to lose
    several = cut_lineage(groups.groupBy("component_id").count().where("count > 1").select("component_id"))
    members = join_counted(groups, several, ["component_id"], "left_semi", 16).join(ids, "key")
    stays = members.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = cut_lineage(members.join(stays, "component_id").where("key <> first.key").select("key"))
    return join_counted(rows, gone, ["key"], "left_anti", 16).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole: not at all, once or twice. Rows without words are not taken."""
    ship_package(spark)
    rows = keyed_rows(docs)
    taken = mix_documents(rows.select("key", "row.doc_id", "row.text", "row.source"), row_key="key").where("size > 0")
    times = taken.select("key", F.floor(F.col("taken") / F.col("size")).cast("int").alias("times"))
    times = cut_lineage(times.where("times > 0"))
    joined = join_counted(rows, times, ["key"], "inner", 24)
    return joined.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text, as ids of a public vocabulary."""
    ship_package(spark)
    return encode_samples(docs, load_pieces())


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: The line model is trained, which SQL cannot state; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, out, sf_dir)
        if name != STAGES[-1][0]:
            out = cut_lineage(out)
    return out
