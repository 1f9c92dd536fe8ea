"""Small Spark helpers shared by the operators: table reads, hold-out split, ranged numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.session import ensure_checkpoint_dir

FILE_ROWS, FILE_BYTES = 8000, 4 << 20  # what makes a stored file worth its while; more files than that are not needed


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def split_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (the fixed hold-out rule); null ids give null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)).cast("int")


def files_for(spark: SparkSession, rows: int, size: int | None = None) -> int:
    """Files that ``rows`` rows of ``size`` bytes in all are worth: at least one a core, so that no core waits."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS), -(-(size or 0) // FILE_BYTES))


def in_files(df: DataFrame, files: int | None) -> DataFrame:
    """``df`` written by at most ``files`` tasks (see ``files_for``) if that is below the number of shuffle partitions.

    A file costs a few calls to its store (on a local one each is a process that the executor starts), which exceed
    the work where a partition holds a few rows. The rows are dealt anew: to coalesce would run the small partitions one
    after another in a task, with the memory of all their sorts.
    """
    if files is None or files >= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(files)


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back.

    Cuts the lineage like ``checkpoint()``, but keeps columnar files with pruning, and the rows of a
    recomputed task cannot change between two uses. ``files``: see ``in_files``.
    """
    spark = df.sparkSession
    df = in_files(df, files)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], size: Column | None = None, group: list[str] | None = None) -> DataFrame:
    """Adds ``_row`` (0-based number in ``order``), ``_before`` (sum of ``size`` of all earlier rows),
    ``_total`` (of all rows) and, with ``group`` (a prefix of ``order``), ``_row`` counted within the group.

    Rows are range-partitioned by ``order``, numbered within their partition, and shifted by totals of
    the earlier partitions: one row per partition, or per partition and group where a group spans
    partitions, so the broadcast side is bounded by the partition count. No key is gathered in one task:
    a group larger than a partition is cut into several. Rows equal in all of ``order`` and meeting in
    one value stay together; callers end ``order`` with columns that tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.withColumn("_size", size.cast("long") if size is not None else F.lit(0).cast("long"))
    ranged = stored(sized.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
                    .withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        spans = (ranged.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n")))
        wide = (spans.groupBy(*group).agg(F.collect_list(F.struct("_pid", "_n")).alias("_parts"))
                .where(F.size("_parts") > 1)
                .select(*[F.col(c).alias(f"_g_{c}") for c in group], F.explode("_parts").alias("_p"), "_parts")
                .select(*[f"_g_{c}" for c in group], F.col("_p._pid").alias("_g_pid"),
                        F.aggregate(F.filter("_parts", lambda x: x["_pid"] < F.col("_p._pid")),
                                    F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_offset")))
        local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", *group).orderBy(
            *[F.col(c).asc_nulls_first() for c in order])))
        on = (F.col("_pid") == F.col("_g_pid"))
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        return (local.join(F.broadcast(wide), on, "left")
                .withColumn("_row", F.col("_local") - 1 + F.coalesce("_offset", F.lit(0)))
                .drop("_local", "_offset", "_pid", "_size", "_g_pid", *[f"_g_{c}" for c in group]))
    totals = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    offsets = totals.select("_pid", F.sum("_s").over(Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
                            F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_size_before"))
    return (ranged.withColumn("_local", F.row_number().over(inside))
            .withColumn("_upto", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .join(F.broadcast(offsets), "_pid")
            .withColumn("_row", F.col("_rows_before") + F.col("_local") - 1)
            .withColumn("_before", F.col("_size_before") + F.col("_upto") - F.col("_size"))
            .drop("_local", "_upto", "_rows_before", "_size_before", "_pid", "_size"))
