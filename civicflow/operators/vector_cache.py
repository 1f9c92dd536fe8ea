"""K2/M5: a cache of text vectors, bucketed by text hash and kept apart by encoder version.

The cache is a Parquet table clustered by ``text_sha256`` into a fixed number of buckets at a shared path. Looking up
which texts are missing, or the vectors of a set of texts, shuffles those texts only: the cache's buckets are read as
they lie. A new encoder version is a new folder, so versions never mix and an old one can be dropped as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.operators.encoder import hashed_encoder

BUCKETS = 64


class VectorCache:
    def __init__(self, spark: SparkSession, path: str, version: str = "hashed-1", buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/{hashlib.sha256(version.encode()).hexdigest()[:16]}"
        # the catalog knows the buckets; the name only has to be unique in it
        self.name = "vector_cache_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, embedding ARRAY<FLOAT>) USING parquet "
                  f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, texts: DataFrame, text_col: str) -> DataFrame:
        """(text_sha256, text): one row a text that the cache does not have; null texts are left out.

        The texts are dealt by the hash that the buckets use, so the anti-join moves nothing of the cache.
        """
        keyed = (texts.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("text_sha256"), F.col(text_col).alias("text"))
                 .repartition(self.buckets, "text_sha256").dropDuplicates(["text_sha256"]))
        return keyed.join(self.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def add(self, texts: DataFrame, text_col: str, encoder: Callable | None = None) -> None:
        """Encode and append what is missing, bucket by bucket."""
        todo = self.missing(texts, text_col)
        vectors = hashed_encoder(todo, "text") if encoder is None else todo.withColumn("embedding", encoder(F.col("text")))
        (vectors.select("text_sha256", "embedding").repartition(self.buckets, "text_sha256")
         .write.mode("append").insertInto(self.name))

    def vectors(self, texts: DataFrame, text_col: str) -> DataFrame:
        """``texts`` with the column ``embedding`` of the cached vector, null where there is none."""
        keyed = texts.withColumn("_hash", F.sha2(text_col, 256)).repartition(self.buckets, "_hash")
        cached = self.rows().select(F.col("text_sha256").alias("_cached"), "embedding").hint("merge")
        return keyed.join(cached, F.col("_hash") == F.col("_cached"), "left").drop("_hash", "_cached")
