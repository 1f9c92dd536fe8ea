"""Protection keys as data (F12, F13): a table of versions, read by the tasks that need a key.

A key is never a literal of a plan, a setting of the session or a value on the driver: the table (version, key) lies
at a path that only the job may read, its bytes are made by a task, and they reach the tasks that encrypt through
the broadcast of that table (at most ``MOST_VERSIONS`` rows, checked). Every protected row keeps the version of its
key, so rows of several versions can stand side by side and be moved to the newest one.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.codes import decrypt_text, encrypt_text, sha256_hex
from civicflow.operators.common import row_count_at_most
from civicflow.sources.batch_table import BatchTable

KEYS = "version int, key binary"
KEY_BYTES = 32
MOST_VERSIONS = 1000


class KeyTable:
    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path, KEYS)
        self.spark = spark

    def add_version(self, version: int) -> bool:
        """A new random key; False if the version exists. Its bytes are drawn in a task and only ever written."""
        n_bytes = KEY_BYTES

        def draw(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([os.urandom(n_bytes) for _ in range(batch.num_rows)], pa.binary())],
                                                 names=["version", "key"])

        one = self.spark.range(0, 1, 1, 1).select(F.lit(version).alias("version"))
        return self.table.append(one.mapInArrow(draw, KEYS), version)

    def newest(self) -> int:
        versions = [int(b) for b in self.table.snapshot()]
        if not versions:
            raise ValueError(f"{self.table.path}: no protection key; add a version first")
        return max(versions)

    def rows(self) -> DataFrame:
        keys = self.table.read().select(F.col("version").alias("_version"), F.col("key").alias("_key"))
        if not row_count_at_most(keys, MOST_VERSIONS):
            raise ValueError(f"{self.table.path}: more than {MOST_VERSIONS} key versions")
        return F.broadcast(keys)


def encrypted(df: DataFrame, keys: KeyTable, value: Column, out: str, version_col: str = "key_version") -> DataFrame:
    """``df`` with ``value`` encrypted under the newest key, and that key's version."""
    return (df.withColumn(version_col, F.lit(keys.newest()))
            .join(keys.rows(), F.col(version_col) == F.col("_version"), "left")
            .withColumn(out, encrypt_text(value, F.col("_key"))).drop("_version", "_key"))


def decrypted(df: DataFrame, keys: KeyTable, cipher_col: str, out: str, version_col: str = "key_version") -> DataFrame:
    """``df`` with the text of a cipher column: "" where it does not decrypt, as with an unknown key version."""
    return (df.join(keys.rows(), F.col(version_col) == F.col("_version"), "left")
            .withColumn(out, F.coalesce(decrypt_text(F.col(cipher_col), F.col("_key")), F.lit(""))).drop("_version", "_key"))


def rotated(df: DataFrame, keys: KeyTable, cipher_col: str, version_col: str = "key_version") -> DataFrame:
    """The same rows under the newest key. Rows that do not decrypt keep their cipher text and version."""
    newest = keys.newest()
    plain = decrypted(df.withColumn("_old", F.col(cipher_col)).withColumn("_was", F.col(version_col)), keys, cipher_col, "_plain", version_col)
    moved = encrypted(plain, keys, F.col("_plain"), cipher_col, version_col)
    stays = (F.col("_was") == newest) | (F.col("_plain") == "") | F.col("_was").isNull()
    return (moved.withColumn(cipher_col, F.when(stays, F.col("_old")).otherwise(F.col(cipher_col)))
            .withColumn(version_col, F.when(stays, F.col("_was")).otherwise(F.col(version_col)))
            .select(*df.columns))


def hash_match(attempts: DataFrame, users: DataFrame, key: str, secret: str, hash_col: str, salt: str = "") -> DataFrame:
    """each attempt (``key``, ``secret``) with ``matches``: is there a user with that key and the secret's hash?

    One join on key and hash; the secret itself is not shuffled. Null keys or secrets match nothing.
    """
    hashed = attempts.withColumn("_hash", sha256_hex(secret, salt)).drop(secret)
    known = users.select(F.col(key).alias("_key"), F.col(hash_col).alias("_known")).distinct()
    return (hashed.join(known, (F.col(key) == F.col("_key")) & (F.col("_hash") == F.col("_known")), "left")
            .withColumn("matches", F.col("_known").isNotNull()).drop("_key", "_known", "_hash"))
