"""Small shared operators: size-checked broadcast, keep-first, top-k, first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.session import cut_lineage

# Rows above which a data-derived side is never broadcast.
DEFAULT_BROADCAST_ROWS = 200_000


class TooLargeToBroadcast(ValueError):
    pass


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True iff ``df`` has at most ``limit`` rows, reading at most limit+1."""
    return df.limit(limit + 1).count() <= limit


def broadcast_checked(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after proving the side is small.

    Beyond the bound the frame is returned unhinted, so the planner (and AQE,
    from measured sizes) chooses a shuffle join instead.
    """
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows where any of ``subset`` is null."""
    return df.dropna(how="any", subset=subset)


def fill_blank_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast to string and replace nulls with ''."""
    cols = columns or df.columns
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def keep_first(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """A1: keep the row with the smallest ``order_col`` for each ``key``.

    Two hash aggregations instead of a window: the min per key is combined map
    side, so a key shared by a third of all rows still spreads over every task;
    the survivors are then picked with a semi join on the unique order column.
    """
    keyed = df.withColumn("_dedupe_key", key)
    firsts = keyed.groupBy("_dedupe_key").agg(F.min(order_col).alias(order_col))
    return keyed.join(firsts, on=["_dedupe_key", order_col], how="left_semi").drop("_dedupe_key")


def keep_first_in_place(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """``keep_first`` for wide rows, which stay where they are read: (key, order) pairs alone tell which rows are
    left out, and if those are few they are broadcast (else the rows are shuffled as there). Runs a job at once."""
    slim = df.select(key.alias("_dedupe_key"), order_col)
    firsts = slim.groupBy("_dedupe_key").agg(F.min(order_col).alias("_first"))
    later = cut_lineage(slim.join(firsts, "_dedupe_key").where(F.col(order_col) > F.col("_first")).select("_dedupe_key", order_col).distinct())
    keyed = df.withColumn("_dedupe_key", key).where(F.col("_dedupe_key").isNotNull() & F.col(order_col).isNotNull())
    return keyed.join(broadcast_checked(later), ["_dedupe_key", order_col], "left_anti").drop("_dedupe_key")


def first_appearance(df: DataFrame, value_col: str, order_col: str, out_rank: str = "first_row",
                     count_col: str | None = None) -> DataFrame:
    """Distinct values with the order key of their first appearance.

    ``first_row`` is itself the stable rank (never renumbered, W5); a dense
    0..n-1 index is only produced by ``dense_index`` for small label sets.
    """
    aggs = [F.min(order_col).alias(out_rank)]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    return df.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(*aggs)


# Inputs up to this many rows are numbered by one global window (one task).
DENSE_INDEX_ONE_TASK_ROWS = 1_000_000


def dense_index(df: DataFrame, order_col: str, out_col: str,
                one_task_rows: int = DENSE_INDEX_ONE_TASK_ROWS) -> DataFrame:
    """A4: 0-based index by ``order_col`` (values unique, e.g. a first row id).

    Label-sized inputs (proved by a bounded count) use one global window.
    Larger ones are numbered in parallel: rows are range-partitioned by
    ``order_col``, numbered inside their partition, and shifted by the number
    of rows in all earlier partitions, taken from a table with one row per
    partition (broadcast; its size is the partition count).
    """
    if row_count_at_most(df, one_task_rows):
        w = Window.orderBy(F.col(order_col).asc())
        return df.withColumn(out_col, (F.row_number().over(w) - 1).cast("int"))
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Materialise the ranged rows once so both uses below see the same
    # partition ids (a checkpoint in the shared folder, not a local one).
    ranged = cut_lineage(df.repartitionByRange(n_parts, F.col(order_col).asc())
                         .withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(F.col(order_col).asc())))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + F.col("_rn") - 1).cast("int"))
            .drop("_pid", "_off", "_rn"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per group by ``order`` (ties need an id).

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so each map task forwards at most k rows per group:
    a hot group is cut down before it reaches a single task.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= k))


def block_partitions(left: DataFrame, right: DataFrame, n_blocks: int,
                     keys: tuple[str, ...] = ("qb", "cb")) -> tuple[DataFrame, DataFrame]:
    """Hash both sides of a blocked cogroup by its block keys into ``n_blocks``
    partitions (one block per task on average).

    Score blocks carry little data but much CPU, so AQE, which sizes
    partitions by bytes, would coalesce the cogroup shuffle into one or two
    tasks. A repartition with an explicit count is kept as planned, and the
    cogroup's clustering on the same keys is then satisfied without another
    shuffle.
    """
    n = max(1, n_blocks)
    return left.repartition(n, *keys), right.repartition(n, *keys)
