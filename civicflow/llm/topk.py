"""Operator 10, exact top-k: tiled matrix products, partial selection per tile, tree merge.

Components become floor(256 x). Every row has a number of its own. Queries are gathered into tiles and candidates
into shards by hash of that number; one task multiplies one tile with one
shard and keeps each query's k best by partial selection (score descending, then id). The lists of a
query are merged over groups of shards, level by level, so no task ever holds more than
``MERGE_FAN * k`` entries a query.

Products run in float64 where the largest possible sum of a pair of rows is below 2**53 (exact); pairs with a row
whose components are larger are multiplied as Python integers, clipped to a long. Defined results: vectors that
are null, empty or hold null or non-finite components take no part, nor do rows with a null id; vectors of another
length than the query's are no candidates of it; rows that share an id are rows like any other, each a candidate of
the others and, if the id is a query, a query with a list of its own; a query with
fewer than k candidates gets all; an empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.llm.frames import stored, table

SCALE = 256
TILE_ROWS = 8192     # queries of a task: shards are sent once for so many
PRODUCT_ROWS = 512   # queries of a matrix product
SHARD_ROWS = 16_384
MERGE_FAN = 32
LISTS = "query_row long, query_id long, shard int, row long, vec_id long, score long"


def _integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, v): usable vectors, to become floor(256 x), with a number for each row."""
    x = F.col("v").cast("array<double>")
    usable = (F.size("v") > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(usable)
            .select(F.monotonically_increasing_id().alias("row"), "id", x.alias("v")))


def best_of_tile(q_ids, q, c_ids, c, k: int, q_rows=None, c_rows=None) -> pd.DataFrame:
    """Each query row's k best candidates of one block, the row itself (by number; by id if none are given) left out."""
    q_rows, c_rows = (q_ids, c_ids) if q_rows is None else (q_rows, c_rows)
    order = np.lexsort((c_rows, c_ids))  # ties then go to the smaller id by position
    c_ids, c, c_rows = c_ids[order], c[order], c_rows[order]
    plain = np.sqrt(2.0**53 / max(q.shape[1], 1))  # rows up to it: no sum of a pair reaches 2**53
    q_large, c_large = (np.abs(m).max(axis=1, initial=0) >= plain for m in (q, c))
    found = [_best_floats(np.where(q_large[:, None], 0, q), np.where(c_large[:, None], 0, c), q_large, c_large, q_rows, c_rows, k)]
    if q_large.any() or c_large.any():
        found.append(_best_integers(q, c, q_large, c_large, q_rows, c_rows))
    rows, cols, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((cols, ~score, rows))  # ~score falls as score rises, without overflow
    rows, cols, score = rows[order], cols[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    rows, cols = rows[keep], cols[keep]
    out = pd.DataFrame({"query_id": q_ids[rows], "vec_id": c_ids[cols], "score": score[keep]})
    return out if q_rows is q_ids else out.assign(query_row=q_rows[rows], row=c_rows[cols])


def _best_floats(q, c, q_large, c_large, q_rows, c_rows, k):
    """(query, candidate, score) that may be among the k best of pairs without large rows."""
    s = q @ c.T
    s[q_rows[:, None] == c_rows[None, :]] = -np.inf
    s[q_large] = -np.inf
    s[:, c_large] = -np.inf
    kk = min(k, s.shape[1])
    floor_score = -np.partition(-s, kk - 1, axis=1)[:, kk - 1]
    rows, cols = np.nonzero((s >= floor_score[:, None]) & (s > -np.inf))
    return rows, cols, s[rows, cols].astype(np.int64)


def _best_integers(q, c, q_large, c_large, q_rows, c_rows):
    """(query, candidate, score) of all pairs with a large row, as exact integers clipped to a long."""
    exact = lambda m: [[int(x) for x in r] for r in m]
    rows, cols, score = [], [], []
    every, large = exact(c), np.flatnonzero(c_large).tolist()
    for i, r in enumerate(exact(q)):
        for j in (range(len(every)) if q_large[i] else large):
            if q_rows[i] != c_rows[j]:
                rows.append(i)
                cols.append(j)
                score.append(max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(r, every[j])))))
    return np.array(rows, int), np.array(cols, int), np.array(score, np.int64)


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row.

    ``is_query`` is an expression over the id, called ``id``.
    """
    vectors = stored(_integer_vectors(df, id_col, vec_col))
    n_q = vectors.where(is_query).count()
    n_tiles = max(1, math.ceil(n_q / TILE_ROWS))
    n_shards = max(1, math.ceil(vectors.count() / SHARD_ROWS),
                   min(df.sparkSession.sparkContext.defaultParallelism * 2, vectors.count() // 1024))
    block = lambda n, seed: F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = vectors.where(is_query).select("row", "id", "v", block(n_tiles, 1).alias("tile"), every(n_shards).alias("shard"))
    c = vectors.select(F.col("row").alias("c_row"), F.col("id").alias("c_id"), F.col("v").alias("c_v"),
                       every(n_tiles).alias("tile"), block(n_shards, 2).alias("shard"))
    n_blocks = n_tiles * n_shards
    q, c = q.repartition(n_blocks, "tile", "shard"), c.repartition(n_blocks, "tile", "shard")
    names = ["query_row", "query_id", "row", "vec_id", "score"]

    def product(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, qs in a.groupby(a["v"].map(len)):
            cs = b[b["c_v"].map(len) == width]
            if len(cs):
                candidates = np.floor(np.stack(cs["c_v"].to_numpy()).astype(np.float64) * SCALE)
                for at in range(0, len(qs), PRODUCT_ROWS):
                    some = qs.iloc[at:at + PRODUCT_ROWS]
                    found.append(best_of_tile(
                        some["id"].to_numpy(), np.floor(np.stack(some["v"].to_numpy()).astype(np.float64) * SCALE),
                        cs["c_id"].to_numpy(), candidates, k, some["row"].to_numpy(), cs["c_row"].to_numpy()))
        out = pd.concat(found) if found else pd.DataFrame({c: np.array([], np.int64) for c in names})
        return out.assign(shard=np.int32(key[1]))[["query_row", "query_id", "shard", "row", "vec_id", "score"]]

    lists = q.groupBy("tile", "shard").cogroup(c.groupBy("tile", "shard")).applyInPandas(product, LISTS)
    best = [F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc()]
    left = n_shards
    while left > MERGE_FAN:
        left = math.ceil(left / MERGE_FAN)
        lists = lists.withColumn("shard", F.expr(f"shard div {MERGE_FAN}").cast("int"))
        near = Window.partitionBy("query_row", "shard").orderBy(*best)
        lists = lists.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")
    last = Window.partitionBy("query_row").orderBy(*best)
    return (lists.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("id") % 50 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
