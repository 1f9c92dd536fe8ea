"""Operator 4, quality classifier: regularised quadratic discriminant analysis.

Each text becomes ``FEATURES`` transformed statistics. The two classes' means and covariances come from
sums over all learning rows (each task adds up its rows; one row a class and entry is collected, a fixed
number). A class covariance is shrunk to the pooled one and to its scaled identity,

    S_k' = (1 - a) ((1 - b) S_k + b S_pooled) + a tr(.) / p I,

and its Cholesky factor is computed once and kept with the model. A score is the logistic of the
difference of log prior + Gaussian log densities, through the Mahalanobis distances of that factor.

Defined results: null and empty texts are scored like any other (all statistics at their empty values);
texts of any length are read whole; without learning rows of both classes every score is the share of
label 1 (0.5 without any); a null label or id is no learning row; a repeated label row counts each time;
an empty table gives an empty result; labels, lang, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.llm.frames import split_remainder, table
from civicflow.llm.words import chunks, text_buffer, word_hashes, word_spans

SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.02
LEARN_MOD, HELD_OUT = 3, 1
CUT = 0.5

FEATURES = ["log_words", "word_bytes", "upper", "digit", "mark", "other", "capital_words", "distinct_words",
            "top_word", "repeated_next", "marked_words", "edge_marks", "lone_marks", "line_words", "repeated_lines",
            "wide_marks"]

# byte classes: 0 blank, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 above ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:33] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4


def _logit(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share of ``n``, smoothed by half a count."""
    return np.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def text_statistics(column) -> np.ndarray:
    """One row of ``FEATURES`` for each row of an Arrow text column."""
    data, offsets = text_buffer(column)
    parts = [_chunk_statistics(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _chunk_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    kind = _CLASS[data]
    share = lambda mask, ends: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])
    n_bytes = np.diff(offsets).astype(float)
    by_kind = [share(kind == k, offsets) for k in range(7)]
    solid = np.maximum(n_bytes - by_kind[0], 1)
    starts, ends, ptr = word_spans(data, offsets)
    n = np.diff(ptr).astype(float)
    some = np.maximum(n, 1)
    hashes = word_hashes(data, starts, ends)
    first, last = kind[starts], kind[ends - 1]
    marks = np.concatenate([[0], np.cumsum(kind == 5)])
    marked = marks[ends] > marks[starts]
    lone = marked & (ends - starts == 1)
    same = np.append(False, hashes[1:] == hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    same[ptr[:-1][ptr[:-1] < len(hashes)]] = False
    distinct, top, lines, line_repeats = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line_of = newline[starts]
    for r in range(rows):
        h = hashes[ptr[r]:ptr[r + 1]]
        if not len(h):
            continue
        s = np.sort(h)
        edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        distinct[r], top[r] = len(edge), np.diff(np.append(edge, len(s))).max()
        at = line_of[ptr[r]:ptr[r + 1]]
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        lines[r] = len(cut)
        if len(cut) > 1:
            sums = np.add.reduceat(h * np.arange(1, 2 * len(h), 2, dtype=np.uint64)[np.arange(len(h)) - np.repeat(
                cut, np.diff(np.append(cut, len(h))))], cut)
            line_repeats[r] = len(cut) - len(np.unique(sums))
    per_word = lambda mask: _logit(share(mask, ptr) / some, some)
    columns = [
        np.log1p(n), np.log1p(solid / some),
        *[_logit(np.minimum(by_kind[k] / solid, 1), solid) for k in (2, 3, 4, 5)],
        per_word(first == 2),
        _logit(distinct / some, some) + 0.5 * np.log1p(n),
        np.log((top + 1) / (some + 1)), per_word(same), per_word(marked), per_word(last == 5), per_word(lone),
        np.log1p(n / np.maximum(lines, 1)), _logit(line_repeats / np.maximum(lines, 1), np.maximum(lines, 1)),
        np.log((by_kind[5] + by_kind[4] + 1) / (some + 1))]
    return np.column_stack(columns)


@dataclass
class QuadraticModel:
    """Class means, inverse Cholesky factors and log weights; ``prior`` alone if a class is missing."""
    means: np.ndarray
    inverse_factors: np.ndarray
    log_weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        log_density = [w - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
                       for m, f, w in zip(self.means, self.inverse_factors, self.log_weights)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def discriminant(counts, sums, products, pooled: float = SHRINK_POOLED,
                 identity: float = SHRINK_IDENTITY) -> QuadraticModel:
    """The model from each class's row count, sum and sum of outer products."""
    total = counts.sum()
    if not (counts > 1).all():
        return QuadraticModel(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0),
                              float(counts[1] / total) if total else 0.5)
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    common = scatter.sum(axis=0) / total
    p = means.shape[1]
    factors, weights = [], []
    for k in (0, 1):
        s = (1 - pooled) * scatter[k] / counts[k] + pooled * common
        s = (1 - identity) * s + (identity * np.trace(s) / p + 1e-9) * np.eye(p)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        weights.append(np.log(counts[k] / total) - np.log(np.diag(lower)).sum())
    return QuadraticModel(means, np.array(factors), np.array(weights), float(counts[1] / total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> QuadraticModel:
    """Learn from all labelled rows outside the hold-out; only the sums reach the driver."""
    p = len(FEATURES)
    learn = (labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("l_id"), F.col(label_col).alias("label"))
             .where(split_remainder("l_id", LEARN_MOD) != HELD_OUT))

    def describe(batches):
        for batch in batches:
            x = text_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), p).cast(pa.list_(pa.float64()))],
                names=["id", "x"])

    def add(batches):
        total = {}
        for batch in batches:
            label = np.array(batch.column(0))
            x = np.array(batch.column(1).flatten()).reshape(-1, p)
            for k in np.unique(label):
                part = np.column_stack([np.ones((label == k).sum()), x[label == k]])
                total[int(k)] = total.get(int(k), 0) + part.T @ part  # count, sums and products in one matrix
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())],
                names=["label", "place", "value"])

    described = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .where(F.col("id").isNotNull() & (split_remainder("id", LEARN_MOD) != HELD_OUT))
                 .mapInArrow(describe, "id long, x array<double>"))
    sums = (described.join(learn, F.col("id") == F.col("l_id")).select(F.col("label").cast("int"), "x")
            .mapInArrow(add, "label int, place int, value double")
            .groupBy("label", "place").agg(F.sum("value").alias("value")).collect())  # 2 (p + 1)**2 rows
    m = np.zeros((2, (p + 1) ** 2))
    for r in sums:
        m[r.label, r.place] = r.value
    m = m.reshape(2, p + 1, p + 1)
    return discriminant(m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 1:])


def score(docs: DataFrame, model: QuadraticModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (a column of that name is replaced): the probability of label 1.

    Only the text goes to Python, and only the score comes back.
    """
    def run(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(text_statistics(text)))

    return docs.drop(out).withColumn(out, F.arrow_udf(run, T.DoubleType())(F.col(text_col)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return (score(docs, model).select("doc_id", (split_remainder("doc_id", LEARN_MOD) == HELD_OUT).alias("held_out"),
                                      "score", (F.col("score") >= CUT).cast("int").alias("predicted")))
