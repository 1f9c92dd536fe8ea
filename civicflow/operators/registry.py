"""User registry jobs: validation split, insert-if-absent, identifier protection.

P12, K5, J12, F12, F13. Keys are data, kept in a table of versions (``operators.keys``), and no plan or setting
holds their bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.codes import decrypt_text, sha256_hex, valid_gov_id
from civicflow.functions.text import py_strip
from civicflow.operators.keys import KeyTable, encrypted
from civicflow.session import cut_lineage, ensure_checkpoint_dir
from civicflow.sources.batch_table import BatchTable

KEYS_CONF = "civicflow.protect.keys"  # path of the table of keys
SALT_CONF = "civicflow.protect.salt"

STATUS_MISSING = "missing_field"
STATUS_INVALID = "invalid_id"
STATUS_EXISTS = "already_exists"
STATUS_INSERTED = "inserted"


def protection_keys(spark: SparkSession, throw_away: bool = False) -> KeyTable:
    """The configured table of keys. Without one this is an error, unless the caller only needs a key that
    nobody looks for after the job (``throw_away``: checks that store nothing)."""
    path = spark.conf.get(KEYS_CONF, None)
    if path:
        return KeyTable(spark, path)
    if not throw_away:
        raise ValueError(f"set {KEYS_CONF} to a table of keys: ids encrypted without it cannot be read again")
    keys = KeyTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/keys-{uuid.uuid4().hex}")
    keys.add_version(1)
    return keys


def registration_status(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Classify each request; the first valid request per new
    mobile (smallest event_id) inserts, later ones find it existing.

    Two hash aggregations and two joins on ``mobile``; no window, so a mobile
    sent by a third of all requests does not land in one task.
    """
    def blank(c: str) -> Column:
        return F.coalesce(py_strip(F.col(c)) == "", F.lit(True))
    base = requests.withColumn(
        "_pre", F.when(blank("mobile") | blank("password") | blank("gov_id"), F.lit(STATUS_MISSING))
        .when(~valid_gov_id("gov_id"), F.lit(STATUS_INVALID)))
    known = existing.select("mobile").distinct().withColumn("_known", F.lit(True))
    firsts = (base.where(F.col("_pre").isNull()).groupBy("mobile")
              .agg(F.min("event_id").alias("_first_event")))
    out = base.join(known, "mobile", "left").join(firsts, "mobile", "left")
    status = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
              .when(F.col("_known"), F.lit(STATUS_EXISTS))
              .when(F.col("event_id") == F.col("_first_event"), F.lit(STATUS_INSERTED))
              .otherwise(F.lit(STATUS_EXISTS)))
    return out.withColumn("status", status).drop("_pre", "_known", "_first_event")


def new_users(status: DataFrame, spark: SparkSession, keys: KeyTable, salt: str | None = None) -> DataFrame:
    """The user rows of inserted requests: protected fields, the request's address, age and created_at where
    it has them (a missing time is now, UTC), and the event that they come from."""
    salt = salt if salt is not None else (spark.conf.get(SALT_CONF, "") or "")
    ins = encrypted(status.where(F.col("status") == STATUS_INSERTED), keys, py_strip(F.col("gov_id")), "gov_id_cipher")
    given = lambda c, t: F.col(c).cast(t) if c in status.columns else F.lit(None).cast(t)
    return ins.select("user_id", "mobile", sha256_hex("password", salt).alias("password_hash"), "gov_id_cipher", "key_version",
                      given("address", "string").alias("address"), given("age", "int").alias("age"),
                      F.coalesce(given("created_at", "timestamp"), F.current_timestamp()).alias("created_at"),
                      given("event_id", "long").alias("event_id"))


USERS = ("user_id long, mobile string, password_hash string, gov_id_cipher string, key_version int, address string, age int, "
         "created_at timestamp, event_id long")
PROGRESS = ("user_id long, articles_viewed long, topics_completed long, chatbot_usage_count long, quiz_score long")


class UserStore:
    """Users and their progress rows as tables of committed batches.

    A batch of requests is registered as one step: users first, then the zeroed progress of the users that this
    batch added. A retry after a stop between the two finds the users' batch and writes the missing progress only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: KeyTable):
        self.spark, self.keys = spark, keys
        self.users = BatchTable(spark, f"{path}/users", USERS)
        self.progress = BatchTable(spark, f"{path}/progress", PROGRESS)

    def register(self, requests: DataFrame, batch: str) -> DataFrame:
        """Add the valid requests with a new mobile; returns the status of every request, as of this batch."""
        earlier = {b: m for b, m in self.users.snapshot().items() if b != batch}
        status = cut_lineage(registration_status(requests, self.users.read(earlier)))
        self.users.append(new_users(status, self.spark, self.keys), batch)
        added = self.users.read({batch: self.users.snapshot()[batch]})
        self.progress.append(zero_progress(added), batch)
        return status


def zero_progress(users: DataFrame) -> DataFrame:
    return users.select("user_id", *[F.lit(0).cast("long").alias(c) for c in
                                     ["articles_viewed", "topics_completed", "chatbot_usage_count", "quiz_score"]])


def _tampered(token: Column) -> Column:
    """The token with the bits of its last byte turned over."""
    raw = F.unbase64(token)
    last = F.conv(F.hex(F.substring(raw, -1, 1)), 16, 10).cast("int")
    return F.base64(F.concat(F.substring(raw, F.lit(1), F.octet_length(raw) - 1),
                             F.unhex(F.lpad(F.hex(F.lit(255) - last), 2, "0"))))


def protect(df: DataFrame, spark: SparkSession, secret_col: str, id_col: str, hash_cols: list[str],
            salt: str = "") -> DataFrame:
    """hash ``hash_cols``, encrypt ``id_col`` and verify both ways."""
    keys = protection_keys(spark, throw_away=True)  # the cipher text itself is not returned
    out = encrypted(df, keys, F.col(id_col), "_cipher", "_used").join(keys.rows(), F.col("_used") == F.col("_version"), "left")
    key = F.col("_key")
    cols = [F.col(c) for c in df.columns if c not in hash_cols and c != id_col]
    return out.select(*cols,
                      *[sha256_hex(c, salt).alias(f"{c}_sha256") for c in hash_cols],
                      valid_gov_id(id_col).alias(f"{id_col}_valid"),
                      (decrypt_text(F.col("_cipher"), key) == F.col(id_col)).alias("roundtrip_ok"),
                      (decrypt_text(_tampered(F.col("_cipher")), key) == F.lit("")).alias(
                          "tamper_rejected"))
