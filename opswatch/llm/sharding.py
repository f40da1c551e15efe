"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the published jump consistent hash.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 24) - 1
_C = (MULTIPLIER & _LOW, MULTIPLIER >> 24 & _LOW, MULTIPLIER >> 48)
#: Rows that share a chunk number, over all shards; a shard's rows are numbered chunk by chunk.
CHUNK_ROWS = 2_000_000


def _limbs(key: Column) -> list[Column]:
    """A 64-bit number in pieces of 24, 24 and 16 bits, whose products stay inside a long."""
    return [
        key.bitwiseAND(F.lit(_LOW)),
        F.shiftright(key, 24).bitwiseAND(F.lit(_LOW)),
        F.shiftrightunsigned(key, 48).bitwiseAND(F.lit(0xFFFF)),
    ]


def _next(k0: Column, k1: Column, k2: Column) -> list[Column]:
    """key * MULTIPLIER + 1 modulo 2**64, in pieces."""
    low = k0 * F.lit(_C[0]) + F.lit(1)
    mid = F.shiftright(low, 24) + k0 * F.lit(_C[1]) + k1 * F.lit(_C[0])
    high = F.shiftright(mid, 24) + k0 * F.lit(_C[2]) + k1 * F.lit(_C[1]) + k2 * F.lit(_C[0])
    return [low.bitwiseAND(F.lit(_LOW)), mid.bitwiseAND(F.lit(_LOW)), high.bitwiseAND(F.lit(0xFFFF))]


def _top31(pieces: list[Column]) -> Column:
    return F.shiftleft(pieces[2], 15).bitwiseOR(F.shiftright(pieces[1], 9))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of ``shard`` for ``shards`` shards and ``grown`` for one more, by jump consistent hashing.

    The jumps of one key are the same for any number of shards, so one walk answers both. A walk has
    at most ``shards + 1`` jumps and about its logarithm on average: blocks of doubling length are
    entered only by keys that still jump.
    """
    names = ("k0", "k1", "k2")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def step(a: Column, _: Column) -> Column:
        pieces = _next(*(a[n] for n in names))
        jump = F.floor((a["at"] + F.lit(1)) * (F.lit(float(1 << 31)) / (_top31(pieces) + F.lit(1)).cast("double")))
        return F.when(
            a["at"] <= F.lit(shards),
            F.struct(
                *(p.alias(n) for p, n in zip(pieces, names, strict=True)),
                jump.cast("long").alias("at"),
                F.when(a["at"] < F.lit(shards), a["at"]).otherwise(a["shard"]).alias("shard"),
                a["at"].alias("grown"),
            ),
        ).otherwise(a)

    zero = F.lit(0).cast("long")
    start = F.struct(
        *(p.alias(n) for p, n in zip(_limbs(key), names, strict=True)),
        zero.alias("at"), zero.alias("shard"), zero.alias("grown"),
    )
    blocks, total = [], 0
    while total <= shards:
        blocks.append(8 << len(blocks))
        total += blocks[-1]

    def block(a: Column, size: Column) -> Column:
        return F.when(a["at"] <= F.lit(shards), F.aggregate(F.sequence(F.lit(1), size), a, step)).otherwise(a)

    end = F.aggregate(F.array(*map(F.lit, blocks)), start, block)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def shard_documents(docs: DataFrame, shards: int = 40, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every document with its shard, its place there, and its shard once one more is appended.

    ``doc_id`` and the number of shards decide (law ``key``); a row without an id has the key 0.
    ``size`` is the text's UTF-8 bytes plus 16, ``text_crc32`` their checksum; a null text counts
    as no bytes. ``slot`` numbers a shard's rows from 0 without gaps: by chunk, then ``doc_id``,
    size and checksum, so equal rows take neighbouring slots in any order. Chunks come from the key's
    hash and their number from the row count, so no task sorts a whole shard and no key is hot
    unless one id repeats. Only five small columns are shuffled, never the texts. An empty table gives
    no rows; other columns are left out.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    chunks = max(1, -(-docs.count() // chunk_rows))
    chunk = (_top31(_next(*_limbs(key))) % F.lit(chunks)).cast("int")
    where = docs.withColumn("_to", jump_shards(F.col("doc_id"), shards))
    rows = where.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_to.shard").alias("shard"),
        F.col("_to.grown").alias("grown_shard"),
        chunk.alias("_chunk"),
    )
    counts = where.groupBy(F.col("_to.shard").alias("shard"), chunk.alias("_chunk")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_chunk").orderBy("doc_id", "size", "text_crc32")
    return rows.join(starts, ["shard", "_chunk"]).select(
        "doc_id", "size", "text_crc32", "law", "shard",
        (F.col("_start") + F.row_number().over(inside) - F.lit(1)).cast("long").alias("slot"),
        "grown_shard",
    )


SHARDING_SQL = f"""
WITH RECURSIVE walk(doc_id, k, pos, shard, grown) AS (
  SELECT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END,
         CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, n,
         CAST(floor((pos + 1) * (CAST(2147483648 AS DOUBLE) / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT),
         CASE WHEN pos < 40 THEN pos ELSE shard END, pos
  FROM (SELECT *, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS n FROM walk WHERE pos <= 40)
),
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
placed AS (
  SELECT d.doc_id, d.text, octet_length(encode(coalesce(d.text, ''))) + 16 AS size,
         w.shard, w.grown,
         (((CAST(coalesce(d.doc_id, 0) AS HUGEINT) + CASE WHEN d.doc_id < 0 THEN 18446744073709551616 ELSE 0 END)
           * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592
           % greatest(1, -(-(SELECT count(*) FROM documents) // {CHUNK_ROWS})) AS chunk,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(regexp_extract_all(hex(encode(coalesce(d.text, ''))), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS BIGINT))),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM documents d JOIN walk w ON w.doc_id IS NOT DISTINCT FROM d.doc_id CROSS JOIN crc_table
  WHERE w.pos > 40
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM placed
"""
