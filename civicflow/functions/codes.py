"""Deterministic hashing, JSON parsing and identifier protection expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 12 decimal digits (any script: Python's str.isdigit accepts Devanagari digits).
GOV_ID_PATTERN = r"^\p{Nd}{12}$"
GOV_ID_LENGTH = 12


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def md5_bucket(key: Column | str, buckets: int, seed: str | None = None) -> Column:
    """Stable bucket in [0, buckets): first 32 bits of md5(key[:seed]).

    Unlike ``rand()`` this gives the same answer after a task retry or a
    repartition, so samples, splits and "random" picks are reproducible.
    """
    k = _c(key).cast("string")
    if seed is not None:
        k = F.concat(k, F.lit(":"), F.lit(seed))
    return (F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("long")


def md5_order_key(key: Column | str, seed: str) -> Column:
    """Order key for a seeded, retry-safe shuffle (O2)."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit(":"), F.lit(seed)))


def pick_variant(variants: Column | str, *key_cols: Column | str) -> Column:
    """O3: one element of ``variants`` chosen by a hash of the key columns."""
    arr = _c(variants)
    key = F.concat_ws(":", *[_c(k).cast("string") for k in key_cols])
    n = F.size(arr)
    idx = md5_bucket(key, 1 << 30) % F.greatest(n, F.lit(1))  # the rule of triage's variant_key
    return F.when(n > 0, F.try_element_at(arr, (idx + 1).cast("int")))


def parse_options(options_json: Column | str) -> Column:
    """JSON array text -> array<string>; null/empty/bad -> []."""
    parsed = F.from_json(_c(options_json), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def valid_gov_id(value: Column | str) -> Column:
    """12 digits after stripping (digits of any script)."""
    from civicflow.functions.text import py_strip
    return F.coalesce(py_strip(value).rlike(GOV_ID_PATTERN), F.lit(False))


def sha256_hex(value: Column | str, salt: str = "") -> Column:
    """hex SHA-256 of salt||value (null stays null)."""
    v = _c(value).cast("string")
    if salt:
        v = F.concat(F.lit(salt), v)
    return F.sha2(v, 256)


def encrypt_text(value: Column | str, key: Column) -> Column:
    """AES-GCM (random IV per value) -> base64 token."""
    return F.base64(F.aes_encrypt(_c(value).cast("binary"), key, F.lit("GCM")))


def decrypt_text(token: Column | str, key: Column) -> Column:
    """token -> text; a token that does not decrypt gives ''."""
    raw = F.try_aes_decrypt(F.try_to_binary(_c(token), F.lit("base64")), key, F.lit("GCM"))
    return F.coalesce(raw.cast("string"), F.lit(""))
