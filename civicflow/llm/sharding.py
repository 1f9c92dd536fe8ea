"""Operator 5, sharding: global byte-size prefix sums cut at equal targets.

Rows are put in a global order, every row's byte position is the sum of the sizes before it (built
from per-partition totals, see ``frames.numbered``), and shard ``s`` takes the rows whose middle byte
lies in the s-th of ``n_shards`` equal parts of all bytes. Shards are therefore contiguous in the order
and differ from the target by at most one row's size at each end. DataFrame functions only.

Defined results: a null text has size 1 and a null checksum; an empty text size 1 and checksum 0; null
ids sort first; repeated rows are separate rows; an empty table gives an empty result; columns of the
input other than id and text are not read, so their names cannot clash. One row larger than a shard's
target fills its shard alone, and a shard it covers may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import numbered, table

N_SHARDS = 8


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  n_shards: int = N_SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous shards of near equal bytes, ``slot`` gapless from 0.

    The texts are read for their size and checksum only and are never shuffled. Among equal ids the
    order goes on by checksum and size; rows equal in all three are interchangeable.
    """
    slim = docs.select(F.col(id_col).alias(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)
                       .cast("long").alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"))
    rows = numbered(slim, [id_col, "text_crc32", "size"], F.col("size"))
    placed = rows.withColumn("shard", F.least(
        F.lit(n_shards - 1), F.expr(f"((2 * _before + size) * {n_shards}) div (2 * _total)")).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return (placed.join(F.broadcast(firsts), "shard")  # at most n_shards rows
            .select(id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", n_shards: int = N_SHARDS) -> None:
    """Write ``docs`` with unique ids as Parquet folders ``shard=0`` ... in shard order."""
    placed = assign_shards(docs, id_col, n_shards=n_shards).select(id_col, F.col("shard"), F.col("slot"))
    (docs.join(placed, id_col).repartitionByRange(n_shards * 4, "shard", "slot")
     .sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# The checksum (reflected polynomial EDB88320, a fixed value) is spelled out: DuckDB has no function for it.
SHARDS_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
    CASE WHEN text IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
      list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) END AS text_crc32
  FROM documents, crc_table),
p AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (sum(size) OVER ())::BIGINT AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) AS n FROM d),
s AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot,
  NULL::INTEGER AS grown_shard FROM s
"""
