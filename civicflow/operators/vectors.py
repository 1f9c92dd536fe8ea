"""Dense-vector nearest neighbours (J4, W3) and the embedding cache (K2).

Exact cosine top-k as a blocked all-pairs product: queries are hashed into
``qb`` blocks and the corpus into ``cb`` blocks; each (qb, cb) pair is one
cogroup task that multiplies the two blocks with numpy (Arrow batches in and
out) and keeps its local top-k per query. A final ``row_number() <= k``
merges the ``cb`` local lists. Block sizes bound the rows of every task,
whatever the table sizes; the number of blocks is derived from row counts.
Inside a task the product is taken in slices of at most ``SLICE_ENTRIES``
scores, so the scores held at once do not grow with the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.operators.common import block_partitions, top_k_per_group

ORDER_DECIMALS = 9
MAX_CORPUS_BLOCK = 50_000
MAX_QUERY_BLOCK = 20_000
SLICE_ENTRIES = 2_000_000  # scores held at once inside a task
SLICE_COLUMNS = 10_000     # of them, for one query

KNN_SCHEMA = "query_id long, doc_id long, score double"


def _local_top_k(k: int, exclude_self: bool):
    # Self-contained closure (numpy/pandas only): executors need not import us.
    order_decimals, slice_entries, slice_columns = ORDER_DECIMALS, SLICE_ENTRIES, SLICE_COLUMNS

    def with_norms(vecs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack(vecs.to_numpy()).astype(np.float64)
        return m, np.linalg.norm(m, axis=1)

    def best(rows, ids, scores):
        """The ``k`` best of each row: score desc, id."""
        order = np.lexsort((ids, -np.round(scores, order_decimals), rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        return rows[keep], ids[keep], scores[keep]

    def slice_top(qm, qn, qid, cm, cn, cid):
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (qm @ cm.T) / np.outer(qn, cn)
        s[~np.isfinite(s)] = -np.inf
        if exclude_self:
            s[qid[:, None] == cid[None, :]] = -np.inf
        r = np.round(s, order_decimals)
        kk = min(k, s.shape[1])
        # threshold = k-th best rounded score per row; keep everything >= it (ties)
        thr = np.partition(r, r.shape[1] - kk, axis=1)[:, r.shape[1] - kk]
        rows, cols = np.nonzero((r >= thr[:, None]) & np.isfinite(r))
        return best(rows, cid[cols], s[rows, cols])

    def fn(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "doc_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        (qm, qn), (cm, cn) = with_norms(q["vec"]), with_norms(c["vec"])
        qid = q["query_id"].to_numpy(dtype=np.int64)
        cid = c["doc_id"].to_numpy(dtype=np.int64)
        wide = min(len(cid), slice_columns)
        step = max(1, slice_entries // wide)
        found = []
        for lo in range(0, len(qid), step):
            mine = slice(lo, lo + step)
            parts = [slice_top(qm[mine], qn[mine], qid[mine], cm[at:at + wide], cn[at:at + wide], cid[at:at + wide])
                     for at in range(0, len(cid), wide)]
            rows, ids, scores = parts[0] if len(parts) == 1 else best(*(np.concatenate(x) for x in zip(*parts)))
            found.append((qid[mine][rows], ids, scores))
        ids, docs, scores = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": ids, "doc_id": docs, "score": scores})
    return fn


def knn_top_k(queries: DataFrame, q_id: str, q_vec: str, corpus: DataFrame, c_id: str, c_vec: str,
              k: int, exclude_self: bool = False, q_blocks: int | None = None,
              c_blocks: int | None = None) -> DataFrame:
    """Exact cosine top-k: (query_id, doc_id, score, rank) ordered by
    score (rounded to 9 places) desc, then doc_id asc."""
    if q_blocks is None or c_blocks is None:
        from civicflow.operators.tfidf import block_counts
        q_blocks, c_blocks = block_counts(queries.count(), corpus.count(), MAX_QUERY_BLOCK, MAX_CORPUS_BLOCK,
                                          queries.sparkSession.sparkContext.defaultParallelism)
    q = (queries.select(F.col(q_id).cast("long").alias("query_id"), F.col(q_vec).alias("vec"))
         .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    c = (corpus.select(F.col(c_id).cast("long").alias("doc_id"), F.col(c_vec).alias("vec"))
         .withColumn("cb", F.pmod(F.xxhash64("doc_id"), F.lit(c_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    q, c = block_partitions(q, c, q_blocks * c_blocks)
    local = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
             .applyInPandas(_local_top_k(k, exclude_self), KNN_SCHEMA))
    return top_k_per_group(local, ["query_id"],
                           [F.round("score", ORDER_DECIMALS).desc(), F.col("doc_id").asc()], k)


def cache_delta(corpus: DataFrame, id_col: str, text_col: str, cached_keys: DataFrame,
                key_col: str = "text_sha256") -> DataFrame:
    """Texts whose content hash is not yet in the vector cache.

    One row per missing content hash (first ``id_col`` wins), so appending the
    encoded result twice adds nothing the second time.
    """
    keyed = corpus.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias(key_col))
    missing = keyed.join(cached_keys.select(key_col).distinct(), key_col, "left_anti")
    return missing.groupBy(key_col).agg(F.min(id_col).alias(id_col))
