"""Exact deduplication by a 128-bit content hash, with the bytes of equal hashes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import SPACE, join_counted
from opswatch.session import cut_lineage

_GROUP_BYTES = 96


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _led(rows: DataFrame, keys: list[str]) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_uid"))
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), first.alias("_first"))


def exact_duplicates(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document with the document that stays for its text.

    Columns: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``content_hash``. Texts
    are equal when identical after ``normalised``; null counts as empty, so nulls and blank texts of
    the same form are one group. The smallest id stays (a null id only where a group has no other);
    of repeated rows with that id exactly one has ``kept``. Other columns are ignored.

    Ids and digests are written once. Hashes that occur once are done; only the texts of the others
    are compared, grouped by hash and text, so that copies collapse in each task before the
    shuffle and a hot group costs one row per task. A hash found to hold two texts (a collision) is
    taken out and its rows are grouped by their text.
    """
    texts = docs.select("doc_id", normalised("text").alias("_text"))
    hashed = texts.withColumn("content_hash", hash_of(F.col("_text")))
    sha = F.sha2("_text", 256).alias("text_sha256")
    uid = F.monotonically_increasing_id().alias("_uid")
    digests = cut_lineage(hashed.select("doc_id", "content_hash", sha, uid))
    groups = cut_lineage(_led(digests, ["content_hash"]).where("_n > 1"))
    shared = join_counted(hashed.drop("doc_id"), groups.select("content_hash"), ["content_hash"], "left_semi", _GROUP_BYTES)
    collided = cut_lineage(shared.distinct().groupBy("content_hash").count().where("count > 1").select("content_hash"))

    def verdict(rows: DataFrame, led: DataFrame, keys: list[str]) -> DataFrame:
        joined = join_counted(rows, led, keys, "left", _GROUP_BYTES)
        alone = F.col("_n").isNull()
        return joined.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("keep_id"),
            F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("_first._uid") == F.col("_uid"))).alias("kept"),
            "text_sha256",
            "content_hash",
        )

    if collided.isEmpty():
        return verdict(digests, groups, ["content_hash"])
    plain = join_counted(digests, collided, ["content_hash"], "left_anti", _GROUP_BYTES)
    others = join_counted(hashed, collided, ["content_hash"], "left_semi", _GROUP_BYTES)
    others = cut_lineage(others.select("doc_id", "content_hash", "_text", sha, uid))
    keys = ["content_hash", "_text"]
    by_text = cut_lineage(_led(others, keys).where("_n > 1"))
    return verdict(plain, groups, ["content_hash"]).unionByName(verdict(others, by_text, keys))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents whose text is not an earlier one's, with all their columns, whatever these are called.

    Repeated rows with one id and text leave one of them. Rows are told apart by their id and 256 bits of their text, so that
    texts whose 128 bits collide stay apart here as they do in ``exact_duplicates``.
    """
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = exact_duplicates(docs).where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("sha"), same.alias("repeat"))
    gone = cut_lineage(gone.distinct())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").alias("id"), F.sha2(normalised("text"), 256).alias("digest"), whole.alias("row"))
    # the digest comes first in the join, so that a null id never makes it a nested loop
    on = (F.col("digest") == F.col("sha")) & F.col("id").eqNullSafe(F.col("doc_id"))
    repeats = gone.where("repeat")
    kept = join_counted(rows, gone, on, "left_anti", _GROUP_BYTES)
    if not repeats.isEmpty():
        copies = join_counted(rows, repeats, on, "left_semi", _GROUP_BYTES)
        kept = kept.unionByName(copies.dropDuplicates(["id", "digest"]))
    return kept.select("row.*")


EXACT_DEDUP_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""
