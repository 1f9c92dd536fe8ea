"""Operator 13, Merkle dataset manifest: a nested-struct rollup over rank digits.

Every row is a leaf, the SHA-256 of its fields. Leaves of a source are ranked by id; the rank's base-``FAN``
digits become columns and are grouped away one after another inside blocks of ``FAN ** 2`` nodes, each
grouping nesting the structs of its children in rank order under their hash. A block's hash is a node of
the next round, until one node a source is left, its subroot; subroots, ranked by source, go the same way up
to the root. The way down is a ``transform`` over each block's nested structs, which gives every node its
siblings level by level, and one ``explode``: no row joins its siblings, and no leaf row is joined at all. Only
block rows (one for up to ``FAN ** 2`` nodes) meet the path of the block above them.

A block is the most that one row holds, so no source, however large, is gathered in a task. Texts are read
once, where their leaves are hashed. DataFrame functions only.

Defined results: a null field is ``-`` in its leaf; a null source is a source of its own, the first one; null
ids come first in their source, equal ids are ordered by leaf, and rows equal in all fields are
interchangeable; a source with one row has its leaf as subroot, a single subroot is the root; an empty table
gives no rows. Only the named fields are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import numbered, stored, table

FAN = 16            # children of a node
BLOCK = FAN * FAN   # nodes of a row's nested structs
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string."""
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """The digest of all fields: ``-`` for null, else byte count, colon and value."""
    encoded = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
               for c in (f.cast("string") for f in fields)]
    return digest(F.concat(*encoded))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its path (siblings before and after it, level by level) lead to."""
    return F.aggregate(path, leaf, lambda node, level: digest(F.concat(level["before"], node, level["after"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""))


def _siblings(hashes: Column, i: Column) -> Column:
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"),
                    F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("after"))


def _hashes(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: x["_hash"])


def _blocks(nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group, _block, _runs, _n, _hash): up to ``BLOCK`` nodes as structs in structs, with the block's hash.

    ``nodes``: (group, _rank, _hash, _payload); ``_n`` is the number of nodes in the group, on which it depends
    how many levels are left to climb.
    """
    digits = nodes.select(*group, F.expr(f"_rank div {BLOCK}").alias("_block"),
                          F.expr(f"cast(_rank div {FAN} % {FAN} as int)").alias("_d1"),
                          F.expr(f"cast(_rank % {FAN} as int)").alias("_d0"), "_hash", "_payload")
    runs = (digits.repartition(*group, "_block")  # one shuffle serves both groupings
            .groupBy(*group, "_block", "_d1")
            .agg(F.sort_array(F.collect_list(F.struct("_d0", "_hash", "_payload"))).alias("_kids"))
            .withColumn("_hash", digest(F.array_join(_hashes(F.col("_kids")), ""))))
    blocks = (runs.groupBy(*group, "_block")
              .agg(F.sort_array(F.collect_list(F.struct("_d1", "_hash", "_kids"))).alias("_runs")))
    count = nodes.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(F.count(F.lit(1)).alias("_n"))
    top = (F.when(F.col("_n") > FAN, digest(F.array_join(_hashes(F.col("_runs")), "")))
           .when(F.col("_n") > 1, F.col("_runs")[0]["_hash"]).otherwise(F.col("_runs")[0]["_kids"][0]["_hash"]))
    return blocks.join(count, _same(group)).select(*group, "_block", "_runs", "_n", top.alias("_hash"))


def _same(group: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])


def climb(nodes: DataFrame, group: list[str], most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(group, _rank, _hash, _payload, _path, _subroot, _root) of every node.

    ``most`` is the largest number of nodes in a group. ``crown`` gets the last node of each group, as
    (group, _rank, _hash, _payload), and returns it with (_path, _subroot, _root) above it.
    """
    blocks = stored(_blocks(nodes, group))
    ups = blocks.select(*group, F.col("_block").alias("_rank"), "_hash", F.lit(0).alias("_payload"))
    above = climb(ups, group, -(-most // BLOCK), crown) if most > BLOCK else crown(ups)
    above = above.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_rank").alias("_of_block"),
                         F.col("_path").alias("_above"), "_subroot", "_root")
    met = blocks.join(above, _same(group) & (F.col("_block") == F.col("_of_block")))
    here = lambda ok, level: F.when(ok, F.array(level)).otherwise(F.array().cast(
        "array<struct<before:string,after:string>>"))
    runs = F.col("_runs")

    def with_paths(run: Column, j: Column) -> Column:
        return F.transform(run["_kids"], lambda kid, i: F.struct(
            (F.col("_block") * BLOCK + run["_d1"] * FAN + kid["_d0"]).alias("_rank"), kid["_hash"].alias("_hash"),
            kid["_payload"].alias("_payload"),
            F.concat(here(F.col("_n") > 1, _siblings(_hashes(run["_kids"]), i)),
                     here(F.col("_n") > FAN, _siblings(F.col("_run_hashes"), j)), F.col("_above")).alias("_path")))

    return (met.withColumn("_run_hashes", _hashes(runs))
            .select(*group, "_subroot", "_root", F.explode(F.flatten(F.transform(runs, with_paths))).alias("_node"))
            .select(*group, "_node.*", "_subroot", "_root"))


def merkle_manifest(leaves: DataFrame, id_col: str = "doc_id", source_col: str = "source", leaf_col: str = "leaf",
                    payload: list[str] = ()) -> DataFrame:
    """(id, source, leaf, subroot, root, path, payload columns) of every row of ``leaves``.

    ``path`` holds one (before, after) pair of joined sibling hashes a level, from the leaf up to the root.
    """
    rows = stored(leaves.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(leaf_col).alias("_hash"),
                                F.struct(F.col(id_col).alias("_id"), *payload).alias("_payload")))
    nodes = (numbered(rows, ["_source", "_id", "_hash"], group=["_source"])
             .select("_source", F.col("_row").alias("_rank"), "_hash", "_payload"))
    most = rows.groupBy("_source").count().agg(F.max("count").alias("n"), F.count(F.lit(1)).alias("sources")).first()

    def last(tops: DataFrame) -> DataFrame:
        return (tops.withColumn("_path", F.array().cast("array<struct<before:string,after:string>>"))
                .withColumn("_subroot", F.col("_hash")).withColumn("_root", F.col("_hash")))

    def sources(tops: DataFrame) -> DataFrame:
        ranked = (numbered(tops.select("_source", "_hash"), ["_source"])
                  .select(F.lit(0).alias("_all"), F.col("_row").alias("_rank"), "_hash",
                          F.struct("_source").alias("_payload")))
        return (climb(ranked, ["_all"], most.sources, last)
                .select(F.col("_payload._source").alias("_source"), F.lit(0).cast("long").alias("_rank"), "_path",
                        F.col("_hash").alias("_subroot"), "_root"))

    out = climb(nodes, ["_source"], most.n or 0, sources)
    return out.select(F.col("_payload._id").alias(id_col), F.col("_source").alias(source_col), F.col("_hash").alias(leaf_col),
                      F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"),
                      *[F.col(f"_payload.{c}") for c in payload])


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered copy of some still verifies."""
    docs = table(spark, sf_dir, "documents", FIELDS)
    lowered = F.translate("text", UPPER, LOWER)
    fields = lambda text: [F.col(c) for c in FIELDS[:-1]] + [text]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_hash(fields(F.col("text"))).alias("leaf"),
                         F.when(hit, leaf_hash(fields(lowered))).alias("tampered"))
    found = merkle_manifest(leaves, payload=["tampered"])
    return (found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _enc(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


# The checksum (reflected polynomial EDB88320, a fixed value) is spelled out: DuckDB has no function for it.
MANIFEST_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (
  SELECT doc_id, source, sha256({" || ".join(map(_enc, FIELDS))}) AS leaf,
    sha256({" || ".join(map(_enc, FIELDS[:-1]))} || {_enc(f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered,
    xor(4294967295, list_reduce(list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS crc
  FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (
  SELECT 0 AS level, source, pos AS r, leaf AS h, n FROM l
  UNION ALL
  SELECT level + 1, source, r // {FAN}, sha256(string_agg(h, '' ORDER BY r)), (n + {FAN - 1}) // {FAN}
  FROM t WHERE n > 1 GROUP BY level, source, r // {FAN}, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos AS r, h, n FROM s
  UNION ALL
  SELECT level + 1, r // {FAN}, sha256(string_agg(h, '' ORDER BY r)), (n + {FAN - 1}) // {FAN}
  FROM u WHERE n > 1 GROUP BY level, r // {FAN}, n),
lower_path AS (
  SELECT a.source, a.level, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS after
  FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.r // {FAN} = b.r // {FAN}
  WHERE a.n > 1 GROUP BY 1, 2, 3),
upper_path AS (
  SELECT a.level, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS after
  FROM u a JOIN u b ON a.level = b.level AND a.r // {FAN} = b.r // {FAN} WHERE a.n > 1 GROUP BY 1, 2),
steps AS (
  SELECT l.source, l.pos, p.level AS step, p.before, p.after
  FROM l JOIN lower_path p ON p.source IS NOT DISTINCT FROM l.source AND p.r = l.pos // ({FAN} ** p.level)::BIGINT
  UNION ALL
  SELECT l.source, l.pos, 1000 + p.level, p.before, p.after
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN upper_path p ON p.r = s.pos // ({FAN} ** p.level)::BIGINT),
paths AS (SELECT source, pos, list({{'b': before, 'a': after}} ORDER BY step) AS path,
    string_agg(before || after, '' ORDER BY step) AS siblings FROM steps GROUP BY 1, 2),
f AS (
  SELECT l.*, s.h AS subroot, (SELECT h FROM u WHERE u.n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    coalesce(path, []) AS path
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos),
g AS (
  SELECT source, pos, 1 AS i, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS node, path FROM f
  UNION ALL
  SELECT source, pos, i + 1, sha256(path[i].b || node || path[i].a), path FROM g WHERE i <= len(path))
SELECT f.doc_id, f.leaf, f.subroot, f.root, f.proof_sha256, g.node AS folded_root, g.node = f.root AS verified
FROM f JOIN g ON g.source IS NOT DISTINCT FROM f.source AND g.pos = f.pos AND g.i = len(f.path) + 1
"""
