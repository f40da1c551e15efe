"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opswatch.llm.common import WORD, join_counted
from opswatch.session import cut_lineage

#: Rows of one chunk of the shuffled order, over all sources.
CHUNK_ROWS = 2_000
#: Rows of one range of finish times.
RANGE_ROWS = 100_000
_KEY_SPAN = float(16**15)


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """A row per source: ``sid`` (rank by code point, null last), ``source_size``, ``target``.

    Weights go to the sources in that order, again and again. The targets sum to ``share`` of all
    sizes; a target that would exceed ``most`` times its source's size stops there and the excess goes to the
    others by weight, until none is above. The level is found in one ordered pass: sources stop in the
    order of their limit over their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("_reach", "sid")
    before, onward = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.array(*map(F.lit, weights))[(F.col("sid") - 1) % len(weights)]
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    level = (F.lit(share) * F.col("_total") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(onward)
    return (
        sources.withColumn("sid", F.row_number().over(by_name))
        .withColumn("_w", weight.cast("double"))
        .withColumn("_reach", F.lit(most) * F.col("source_size") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", level)
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_reach"), F.struct("_reach", "sid", "_level"))).over(everything)["_level"])
        .select(
            "source", "sid", "source_size", "_total",
            F.when(F.col("source_size") == 0, F.lit(0.0))
            .otherwise(F.least(F.lit(most) * F.col("source_size"), F.col("_level") * F.col("_w"))).alias("target"),
        )
    )


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    chunk_rows: int = CHUNK_ROWS,
    row_key: str | None = None,
) -> DataFrame:
    """What a mix of ``share`` times all words takes of each document.

    Columns: ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words, repeats counted).
    A source's documents queue in an order shuffled by a hash of their id, up to ``most`` times over. A copy's
    virtual finish time is the words of its source up to its end, over the source's target. Copies
    are served by finish time over all sources until the budget is used; the last one is cut there.
    So each source gets its target within one document, and reruns agree.

    Null texts and texts without words have size 0 and give nothing; a null source is a source of its
    own; equal rows are separate documents; an empty table gives no rows; other columns are ignored, but for
    ``row_key``, a number of its own for each row, which comes back with it.
    A source's running sum is split into chunks of the hash, and the global order into ranges of
    finish time, both by row count: no task orders a whole source or the whole mix.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 15), 16, 10)
    sized = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.cast("long").alias("_key"),
            (F.monotonically_increasing_id() if row_key is None else F.col(row_key)).alias("_uid"),
        )
    )
    key_of_row = [] if row_key is None else [F.col("_uid").alias(row_key)]
    rows = sized.count()
    chunks = max(1, -(-rows // chunk_rows))
    targets = cut_lineage(source_targets(sized, weights, share, most))
    chunk = F.least(F.floor(F.col("_key") / F.lit(_KEY_SPAN) * F.lit(chunks)), F.lit(chunks - 1)).cast("int")
    named = targets.withColumnRenamed("source", "_source")
    queued = join_counted(sized, named, F.col("source").eqNullSafe(F.col("_source")), "inner").withColumn("_chunk", chunk)
    sums = queued.groupBy("sid", "_chunk").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "_chunk", F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("sid", "_chunk").orderBy("_key", "doc_id", "size", "_uid")
    placed = queued.join(starts, ["sid", "_chunk"]).select(
        "doc_id", "size", "sid", "source_size", "target", "_total", "_key", "_uid",
        (F.col("_start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("_cum"),
    )
    placed = cut_lineage(placed)

    ranges = max(64, most * rows // RANGE_ROWS)
    copies = placed.where("size > 0").select(
        "*", F.explode(F.array(*map(F.lit, range(most)))).alias("_copy")
    )
    finish = (F.col("_copy") * F.col("source_size") + F.col("_cum")) / F.col("target")
    copies = copies.withColumn("_finish", finish).withColumn("_range", F.floor(F.col("_finish") * F.lit(ranges)))
    budget = F.floor(F.lit(share) * F.col("_total"))
    totals = copies.groupBy("_range").agg(F.sum("size").alias("_words"), F.max(budget).alias("_budget"))
    served = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    last = totals.withColumn("_upto", F.sum("_words").over(served)).where("_upto >= _budget").orderBy("_range").first()
    if last is None:  # no words at all
        return placed.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *key_of_row)
    at, left = last["_range"], last["_budget"] - (last["_upto"] - last["_words"])
    order = Window.orderBy("_finish", "sid", "_key", "doc_id", "_copy", "_uid").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum("size").over(order)
    boundary = copies.where(F.col("_range") == at).select(
        "_uid", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(left) - through + F.col("size"))).alias("_part")
    )
    parts = cut_lineage(boundary.groupBy("_uid").agg(F.sum("_part").alias("_part")))
    whole = sum(
        F.when(
            F.floor((F.lit(c) * F.col("source_size") + F.col("_cum")) / F.col("target") * F.lit(ranges)) < at, F.col("size")
        ).otherwise(F.lit(0))
        for c in range(most)
    )
    mixed = join_counted(placed, parts, ["_uid"], "left")
    taken = F.when(F.col("size") > 0, whole + F.coalesce("_part", F.lit(0))).otherwise(F.lit(0))
    return mixed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *key_of_row)


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), 'mix')), 1, 15) AS BIGINT) AS key
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source
),
weighed AS (
  SELECT *, CAST(CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
         CAST(sum(s) OVER () AS BIGINT) AS total FROM sources
),
reached AS (SELECT *, 2e0 * s / w AS reach FROM weighed),
levels AS (
  SELECT *, (1.5e0 * total - 2e0 * CAST(coalesce(sum(s) OVER (ORDER BY reach, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / sum(w) OVER (ORDER BY reach, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM reached
),
targets AS (
  SELECT source, sid, s, total, CASE WHEN s = 0 THEN 0e0 ELSE least(2e0 * s, w * (
           SELECT level FROM levels WHERE level <= reach ORDER BY reach, sid LIMIT 1)) END AS target
  FROM levels
),
placed AS (
  SELECT d.doc_id, d.size, t.sid, t.s, t.target, t.total, d.key,
         CAST(sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
copies AS (SELECT *, (copy * s + cum) / target AS finish FROM placed, (VALUES (0), (1)) c(copy) WHERE size > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, sid, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS upto FROM copies
),
parts AS (
  SELECT doc_id, CAST(sum(greatest(0, least(size, floor(1.5e0 * total) - (upto - size)))) AS BIGINT) AS taken FROM served GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.s AS source_size, p.target, coalesce(k.taken, 0) AS taken FROM placed p LEFT JOIN parts k USING (doc_id)
"""
