"""Operator 12, embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers, x = floor(64 c) + 1000000; the offset falls out of every centred value, so the tasks
work with floor(64 c). The fit list holds each distinct vector once. Its sums are exact integers; a second pass
adds up the outer products of centred vectors, one matrix a task, entry by entry. The driver gets that
scatter matrix (``dimensions ** 2`` numbers, at most ``MAX_DIM ** 2``), never rows, and factors it:

* Cholesky with diagonal pivoting, P' C P = L L', stopped where the largest remaining pivot is rounding noise, so
  that L has as many columns as C has rank;
* one-sided Jacobi on the columns of P L itself: sweeps of plane rotations over disjoint column pairs until all
  columns are orthogonal. Squared column norms are then the eigenvalues, normalised columns the components.

Every usable row is projected on the leading components, each over the square root of its eigenvalue, and a pass
over the fit list measures how far the covariance of the result is from the identity.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those
of another length than the most frequent one (ties: the longer); a null id stays a null id; rows that repeat a vector
count once in the fit and each get their rows; entries beyond 2**61 in size count as that; directions without variance are no components, so equal vectors, a
single row or an empty table give no rows; ``deviation`` is null where it exceeds a long. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import stored, table

SCALE = 64
COMPONENTS = 16
MAX_DIM = 4096   # of the matrix on the driver: 134 MB
SWEEPS = 60
MOST = 2.0 ** 61  # greatest size of floor(64 c), so that differences of two stay in a long


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """G with G G' = c, its rows in c's order and as many columns as c has rank: P L of the pivoted factor."""
    c = np.array(c, float)
    d = len(c)
    rest = np.diag(c).copy()
    noise = 8 * d * np.finfo(float).eps * max(rest.max(initial=0), 0)
    columns = np.zeros((d, d))
    for k in range(d):
        p = int(np.argmax(rest))
        if rest[p] <= noise:
            return columns[:, :k]
        column = (c[:, p] - columns[:, :k] @ columns[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0  # rows of earlier pivots: zero above the triangle
        columns[:, k] = column
        rest = np.where(rest == -np.inf, -np.inf, rest - column ** 2)
        rest[p] = -np.inf
    return columns


def one_sided_jacobi(g: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of g g': plane rotations until g's columns are orthogonal."""
    g = np.array(g, float)
    r = g.shape[1]
    order = np.arange(r + r % 2)  # a column beyond the last one sits a pair out
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        moved = 0.0
        for _ in range(max(len(order) - 1, 0)):  # every pair once: a round-robin of disjoint pairs
            a, b = order[:len(order) // 2], order[len(order) // 2:][::-1]
            real = (a < r) & (b < r)
            a, b = a[real], b[real]
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            off = np.abs(xy) / np.where(size > 0, size, 1)
            moved = max(moved, off.max(initial=0))
            turn = off > eps
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1)
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            cos = 1 / np.sqrt(1 + t * t)
            g[:, a], g[:, b] = cos * x - cos * t * y, cos * t * x + cos * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if moved <= 4 * eps:
            break
    values = (g * g).sum(axis=0)
    rank = np.argsort(-values, kind="stable")
    return values[rank], g[:, rank] / np.sqrt(values[rank])


@dataclass
class Whitening:
    """Number and exact sums of the fit list, eigenvalues, components (as columns) and their share of the trace."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, whose whole part is taken off exactly first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - sum) ** 2; None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        left = np.array([s % self.n for s in self.sums], np.int64)
        about = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        safe = about < 2.0 ** 62  # then no part of the sum overflows either
        with np.errstate(over="ignore"):
            exact = ((self.n * (x - whole) - left) ** 2).sum(axis=1)
        out = []
        for i, ok in enumerate(safe):
            v = int(exact[i]) if ok else sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i], self.sums))
            out.append(v if v < 2 ** 63 else None)
        return out


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): usable vectors of the most frequent length as floor(64 c)."""
    entries = F.col("v").cast("array<double>")
    usable = (F.size("v") > 0) & F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = stored(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull()).where(usable)
                  .select("id", F.transform(entries, lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(MOST)), F.lit(-MOST)))
                                            .cast("long")).alias("x")))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _added(df: DataFrame, part, entries: int, kind: str) -> list:
    """Sums over all rows of ``part(matrix)``, a flat array of ``entries``: added up in each task, then by entry."""
    arrow = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            for at in range(0, entries, 100_000):
                piece = total[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(piece)), pa.int32()),
                                                  pa.array(piece.tolist(), arrow)], names=["place", "value"])

    out = [0] * entries
    for r in df.mapInArrow(add, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the distinct vectors ``fit_list`` (x); None if nothing varies."""
    first = fit_list.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    if d > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} entries")

    def count_and_sum(x):  # Python's integers: exact at any size
        bound = int(np.abs(x).max(initial=0)) * len(x)
        sums = x.sum(axis=0).tolist() if bound < 2 ** 62 else [sum(c) for c in zip(*x.tolist())]
        return np.array([len(x), *sums], object)

    n, *sums = (int(v) for v in _added(fit_list.select("x"), count_and_sum, d + 1, "decimal(38,0)"))
    model = Whitening(n, sums, np.ones(0), np.zeros((d, 0)), np.zeros(0))
    upper = np.triu_indices(d)

    def scatter(x):
        z = model.centred(x)
        return (z.T @ z)[upper]

    c = np.zeros((d, d))
    c[upper] = _added(fit_list.select("x"), scatter, len(upper[0]), "double")
    c = (c + np.triu(c, 1).T) / n
    values, vectors = one_sided_jacobi(pivoted_cholesky(c))
    k = min(components, len(values))
    return Whitening(n, sums, values[:k], vectors[:, :k], values[:k] / np.trace(c)) if k else None


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)

    def moments(x):
        w = model.project(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = np.array(_added(fit_list.select("x"), moments, k + k * k, "double")) / model.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened array<double>, explained array<double>, identity_error) of every usable row."""
    rows = integer_vectors(df, id_col, vec_col)
    fit_list = stored(rows.select("x").distinct())
    model = fit(fit_list, components)
    schema = "deviation long, whitened array<double>"
    if model is None:
        model, error = Whitening(1, [], np.ones(0), np.zeros((0, 0)), np.zeros(0)), 0.0
        rows = rows.limit(0)
    else:
        error = identity_error(fit_list, model)

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            w = model.project(x) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x) if batch.num_rows else [], pa.int64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))],
                names=[id_col, "deviation", "whitened"])

    id_type = rows.schema["id"].dataType.simpleString()
    return (rows.select("id", "x").mapInArrow(project, f"`{id_col}` {id_type}, {schema}")
            .withColumns({"n": F.lit(model.n).cast("long"), "identity_error": F.lit(error),
                          "explained": F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")}))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    out = whiten(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return (out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
            .select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation",
                    "col.whitened", "col.explained", "identity_error"))
