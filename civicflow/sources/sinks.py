"""Sinks: chat-log append (K1), idempotent appends (K4/K2) and table writes.

Writes go to shared storage paths given by the caller; nothing is written to
a machine-local folder unless a test passes one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions.text import is_blank, py_strip


def chat_log_rows(chats: DataFrame) -> DataFrame:
    """Answered, non-blank messages; message stripped; missing
    timestamps default to now (UTC); a ``dt`` day column for partitioning."""
    ts = F.coalesce(F.col("ts"), F.current_timestamp()) if "ts" in chats.columns else F.current_timestamp()
    return (chats.where(~is_blank("message") & F.col("reply").isNotNull())
            .withColumn("message", py_strip(F.col("message")))
            .withColumn("ts", ts).withColumn("dt", F.to_date("ts")))


def append_chat_log(chats: DataFrame, path: str) -> None:
    """Append to the Parquet chat log partitioned by day (partition pruning on dt)."""
    chat_log_rows(chats).write.mode("append").partitionBy("dt").parquet(path)


def append_new(new: DataFrame, existing: DataFrame | None, key: list[str], path: str) -> int:
    """Append only rows whose key is absent; returns rows appended."""
    todo = new if existing is None else new.join(existing.select(*key).distinct(), key, "left_anti")
    todo = todo.cache()
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    todo.unpersist()
    return n
