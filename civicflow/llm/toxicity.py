"""Operator 1, toxicity: bidirectional gated recurrent network with attention pooling, in numpy.

A word (run of letters, lower-cased) enters as its word vector (hashed) and the mean of the vectors of its
character 3- to 5-grams (hashed), so new forms of a stem are recognised. Windows of ``WINDOW`` words, the
next starting ``STRIDE`` words later, run through a forward and a backward GRU; attention weights pool the
states of a window to one logit. All overlapping windows of the whole text are scored and the largest
counts, shifted from the learning sample's class shares to the label shares.

Learning (on the driver) takes a bounded sample of labelled rows, about ``LEARN_DOCS`` a class by hash of the id,
whatever their length; of a text of more than ``LEARN_BYTES`` bytes a stretch of ``STRETCH``, its place by hash of
the id, is learnt from: a text's highest windows stand for it in each round
(multiple-instance learning). The first dimension of both vector tables starts from smoothed log odds and the others
from zero, so that few learning texts are not told apart by random marks of their words; buckets in
fewer than ``LEAST_DOCS`` learning texts stay zero.
Runs are seeded, so equal rows give equal models.

Defined results: null texts, and texts without letters, score the share of label 1 times ``EMPTY``; texts of
any length are read whole; without learning rows of both classes every score is the share of label 1 (0
without any); repeated label rows count each; an empty table gives an empty result; labels, lang, source
and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import split_remainder, table
from civicflow.llm.language_id import distinct_units, letter_runs
from civicflow.llm.words import chunks, mix, odd_constants, text_buffer

LEARN_MOD, HELD_OUT = 4, 2
LEARN_DOCS, LEARN_BYTES, STRETCH = 1200, 8_000, 4_000
WINDOW, STRIDE = 24, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
WIDTH, HIDDEN = 8, 8
ROUNDS, LEAST_STEPS, BATCH, RATE = 7, 250, 128, 0.01
LEAST_DOCS = 3  # learning texts a bucket must occur in
CUT = 0.3
EMPTY = 0.5
BLOCK = 2048  # windows scored at once


@dataclass
class Units:
    """Distinct words of a chunk with their hashed features."""
    word: np.ndarray       # word bucket of each unit
    gram: np.ndarray       # character buckets of all units, one after another
    gram_unit: np.ndarray
    gram_count: np.ndarray


def unit_features(data: np.ndarray, offsets: np.ndarray) -> Units:
    n = len(offsets) - 1
    unit = np.repeat(np.arange(n), np.diff(offsets))
    left = offsets[1:][unit] - np.arange(len(data)) if n else np.zeros(0, int)
    whole = np.zeros(n, np.uint64)
    if n:
        place = np.arange(len(data)) - offsets[:-1][unit]
        whole = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * odd_constants(64, 21)[place], offsets[:-1]))
    grams, owners = [], []
    for size in GRAMS:
        at = np.flatnonzero(left >= size)
        h = np.zeros(len(at), np.uint64)
        for k, c in enumerate(odd_constants(size, 30 + size)):
            h += (data[at + k].astype(np.uint64) + np.uint64(1)) * c
        grams.append((mix(h) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owners.append(unit[at])
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    return Units((whole % np.uint64(WORD_BUCKETS)).astype(np.int64), gram, owner,
                 np.maximum(np.bincount(owner, minlength=n), 1))


def windows(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, row) of all windows; ``row`` gives each word's row, ascending.

    Windows start every ``STRIDE`` words until one reaches the row's last word.
    """
    ptr = np.searchsorted(row, np.arange(n_rows + 1))
    n = np.diff(ptr)
    number = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(n_rows), number)
    nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    first = ptr[owner] + nth * STRIDE
    return first, np.minimum(WINDOW, ptr[owner + 1] - first), owner


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gru(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (B, T, H) of a GRU whose input parts ``gates`` (B, T, 3H: update, reset, candidate) are given."""
    b, t, h3 = gates.shape
    h_size = h3 // 3
    h = np.zeros((b, h_size), gates.dtype)
    states, cache = np.empty((b, t, h_size), gates.dtype), []
    for k in range(t):
        g = gates[:, k]
        zr = _sigmoid(g[:, :2 * h_size] + h @ u[:, :2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        rh = r * h
        n = np.tanh(g[:, 2 * h_size:] + rh @ u[:, 2 * h_size:])
        new = h + (z * mask[:, k, None]) * (n - h)
        if keep:
            cache.append((h, z, r, rh, n))
        h = new
        states[:, k] = h
    return states, cache


def gru_gradient(d_states: np.ndarray, u: np.ndarray, mask: np.ndarray, cache) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of gates, gradient of u) by back-propagation through time."""
    b, t, h_size = d_states.shape
    d_gates, d_u = np.empty((b, t, 3 * h_size), d_states.dtype), np.zeros_like(u)
    d_h = np.zeros((b, h_size), d_states.dtype)
    for k in reversed(range(t)):
        h, z, r, rh, n = cache[k]
        d_h = d_h + d_states[:, k]
        m = mask[:, k, None]
        d_n = d_h * z * m * (1 - n * n)
        d_z = d_h * (n - h) * m * z * (1 - z)
        d_rh = d_n @ u[:, 2 * h_size:].T
        d_r = d_rh * h * r * (1 - r)
        d_gates[:, k] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_u[:, :2 * h_size] += h.T @ d_gates[:, k, :2 * h_size]
        d_u[:, 2 * h_size:] += rh.T @ d_n
        d_h = d_h * (1 - z * m) + d_rh * r + d_gates[:, k, :2 * h_size] @ u[:, :2 * h_size].T
    return d_gates, d_u


@dataclass
class ToxicityModel:
    params: dict[str, np.ndarray]
    prior: float
    shift: float = 0.0

    def inputs(self, units: Units) -> np.ndarray:
        """Word and mean character vectors of each unit, side by side."""
        p = self.params
        chars = np.column_stack([np.bincount(units.gram_unit, p["char"][units.gram, d], minlength=len(units.word))
                                 for d in range(WIDTH)]) / units.gram_count[:, None]
        return np.concatenate([p["word"][units.word], chars.astype(np.float32)], axis=1)

    def window_logits(self, projected: np.ndarray, unit: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), BLOCK):
            out[at:at + BLOCK] = self.pooled(projected, unit, first[at:at + BLOCK], size[at:at + BLOCK])[0]
        return out

    def pooled(self, projected, unit, first, size, keep: bool = False):
        """Logits of some windows (and, with ``keep``, what back-propagation needs)."""
        p, steps = self.params, np.arange(WINDOW)
        mask = (steps < size[:, None]).astype(np.float32)
        ids = unit[np.minimum(first[:, None] + steps, len(unit) - 1)]
        gates = projected[ids]
        back = np.ascontiguousarray(gates[:, ::-1, 3 * HIDDEN:])
        f, f_cache = gru(gates[:, :, :3 * HIDDEN], p["u_f"], mask, keep)
        b, b_cache = gru(back, p["u_b"], mask[:, ::-1], keep)
        states = np.concatenate([f, b[:, ::-1]], axis=2)
        e = states @ p["attend"] + (mask - 1) * 1e4
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(axis=1)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (ids, mask, f_cache, b_cache, states, a, pooled)) if keep else (logit,)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row of a chunk: its highest window's probability."""
        n = len(offsets) - 1
        starts, ends, row = letter_runs(data, offsets)
        if not self.params:
            return np.full(n, self.prior)
        out = np.full(n, self.prior * EMPTY)
        if len(starts):
            unit, units, unit_offsets = distinct_units(data, starts, ends)
            p = self.params
            projected = self.inputs(unit_features(units, unit_offsets)) @ p["w"] + p["c"]
            first, size, owner = windows(row, n)
            logit = self.window_logits(projected, unit, first, size)
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[at]] = _sigmoid(np.maximum.reduceat(logit, at).astype(float) + self.shift)
        return out


def _by_unit(units: Units) -> Units:
    """The same features with the character buckets in order of their unit."""
    order = np.argsort(units.gram_unit, kind="stable")
    return Units(units.word, units.gram[order], units.gram_unit[order], units.gram_count)


def _grams_of(units: Units, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``gram`` of the listed units, place in the list of each); ``units`` in order of unit."""
    lo, hi = (np.searchsorted(units.gram_unit, which, side=x) for x in ("left", "right"))
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n), np.repeat(np.arange(len(which)), n)


def _start(units: Units, unit: np.ndarray, row: np.ndarray, label: np.ndarray, rng) -> dict[str, np.ndarray]:
    """Random parameters; log odds of word and character buckets in the first dimension."""
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)

    def odds(bucket, rows, size):
        of_row, b = np.divmod(np.unique(rows * size + bucket), size)
        n = np.bincount(b, minlength=size)
        pos = np.bincount(b, label[of_row], minlength=size)
        known.append(n >= LEAST_DOCS)
        rate = label.mean()
        return np.clip(np.log((pos + 4 * rate) / (n + 4)) - np.log((n - pos + 4 * (1 - rate)) / (n + 4))
                       - np.log(rate / (1 - rate)), -3, 3) * n / (n + 8)

    p = {"word": small(WORD_BUCKETS, WIDTH), "char": small(CHAR_BUCKETS, WIDTH),
         "w": small(2 * WIDTH, 6 * HIDDEN) * 3, "c": np.zeros(6 * HIDDEN, np.float32),
         "u_f": small(HIDDEN, 3 * HIDDEN) * 3, "u_b": small(HIDDEN, 3 * HIDDEN) * 3,
         "attend": small(2 * HIDDEN), "out": small(2 * HIDDEN) * 3, "bias": np.zeros(1, np.float32)}
    known = []
    p["word"][:], p["char"][:] = 0, 0
    p["word"][:, 0] = odds(units.word[unit], row, WORD_BUCKETS)
    rows, present = np.divmod(np.unique(row * len(units.word) + unit), len(units.word))
    take, nth = _grams_of(units, present)
    p["char"][:, 0] = odds(units.gram[take], rows[nth], CHAR_BUCKETS)
    for name, often in zip(("word", "char"), known):
        p[name][~often] = 0  # too rare to tell anything but the texts themselves
    return p


def train(texts: list[str], label: np.ndarray, prior: float, rounds: int = ROUNDS, seed: int = 1) -> ToxicityModel:
    """Fit on lower-cased texts with labels 0 and 1; ``prior`` is the share of label 1 to be scored with."""
    label = np.asarray(label, float)
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    starts, ends, row = letter_runs(data, offsets)
    if not len(starts) or not 0 < label.mean() < 1:
        return ToxicityModel({}, prior)
    unit, unit_bytes, unit_offsets = distinct_units(data, starts, ends)
    units = _by_unit(unit_features(unit_bytes, unit_offsets))
    rng = np.random.default_rng(seed)
    model = ToxicityModel(_start(units, unit, row, label, rng), prior)
    p = model.params
    first, size, owner = windows(row, len(texts))
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    at_word = np.minimum(first[:, None] + np.arange(WINDOW), len(unit) - 1)
    hint = model.inputs(units)[:, [0, WIDTH]].max(axis=1)[unit]  # log odds choose the first round's windows
    logit = np.where(np.arange(WINDOW) < size[:, None], hint[at_word], -9).max(axis=1)
    often = {k: (p[k] != 0).any(axis=1)[:, None] for k in ("word", "char")}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = turn = 0
    while turn < rounds or step < LEAST_STEPS:
        if turn:
            logit = model.window_logits(model.inputs(units) @ p["w"] + p["c"], unit, first, size)
        order = np.lexsort((-logit, owner))
        rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
        chosen = order[rank < np.where(label[owner[order]] == 1, 1, 3)]
        rng.shuffle(chosen)
        for k in range(0, len(chosen), BATCH):
            pick = chosen[k:k + BATCH]
            step += 1
            grads = _gradients(model, units, unit, first[pick], size[pick], label[owner[pick]])
            for name in often:
                grads[name] *= often[name]
            for name, g in grads.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[name] -= (RATE / (1 + 2 * turn / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        turn += 1
    share = min(max(prior, 1e-6), 1 - 1e-6)
    model.shift = float(np.log(share / (1 - share)) - np.log(label.mean() / (1 - label.mean())))
    return model


def _gradients(model: ToxicityModel, units: Units, unit, first, size, y) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of some windows, with weight decay on the vectors."""
    p = model.params
    local, back = np.unique(unit[np.minimum(first[:, None] + np.arange(WINDOW), len(unit) - 1)], return_inverse=True)
    take, nth = _grams_of(units, local)
    few = Units(units.word[local], units.gram[take], nth, units.gram_count[local])
    x = model.inputs(few)
    words = back.reshape(len(first), WINDOW)
    flat_first = np.arange(len(first)) * WINDOW
    logit, (ids, mask, f_cache, b_cache, states, a, pooled) = model.pooled(
        x @ p["w"] + p["c"], words.ravel(), flat_first, size, keep=True)
    d_logit = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pool = d_logit[:, None] * p["out"]
    d_a = (states * d_pool[:, None, :]).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
    d_states = a[:, :, None] * d_pool[:, None, :] + d_e[:, :, None] * p["attend"]
    g["attend"] = np.einsum("bt,bth->h", d_e, states)
    d_f, g["u_f"] = gru_gradient(d_states[:, :, :HIDDEN], p["u_f"], mask, f_cache)
    d_b, g["u_b"] = gru_gradient(d_states[:, ::-1, HIDDEN:], p["u_b"], mask[:, ::-1], b_cache)
    d_gates = np.concatenate([d_f, d_b[:, ::-1]], axis=2) * mask[:, :, None]
    order = np.argsort(ids.ravel(), kind="stable")  # every unit of ``local`` occurs
    heads = np.searchsorted(ids.ravel()[order], np.arange(len(local)))
    per_unit = np.add.reduceat(d_gates.reshape(-1, d_gates.shape[2])[order], heads)
    g["w"], g["c"] = x.T @ per_unit, per_unit.sum(axis=0)
    d_x = per_unit @ p["w"].T
    g["word"], g["char"] = 1e-5 * p["word"], 1e-5 * p["char"]
    np.add.at(g["word"], few.word, d_x[:, :WIDTH])
    np.add.at(g["char"], few.gram, (d_x[:, WIDTH:] / few.gram_count[:, None])[few.gram_unit])
    return g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> ToxicityModel:
    """Learn from the bounded sample described above; class shares come from all learning labels."""
    rows = (labels.where(F.col(label_col).isin(0, 1) & (split_remainder(id_col, LEARN_MOD) != HELD_OUT))
            .select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return ToxicityModel({}, prior)
    chance = F.pmod(F.xxhash64("l_id", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    ids = rows.where(chance < F.when(F.col("label") == 1, min(1.0, LEARN_DOCS / counts[1]))
                     .otherwise(min(1.0, LEARN_DOCS / counts[0])))
    size = F.floor(F.length("text") * float(STRETCH) / F.octet_length("text")).cast("int")  # characters of a stretch
    start = F.pmod(F.xxhash64("id", F.lit(31)), F.greatest(F.length("text") - size, F.lit(1))).cast("int") + 1
    sample = (docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).where(F.col("text").isNotNull())
              .withColumn("text", F.when(F.octet_length("text") <= LEARN_BYTES, F.col("text")).otherwise(F.substring("text", start, size)))
              .join(F.broadcast(ids), F.col("id") == F.col("l_id"))  # about 2 * LEARN_DOCS ids
              .select("id", "text", "label").toPandas().sort_values(["id", "label", "text"]))
    return train(list(sample["text"]), sample["label"].to_numpy(), prior)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``score`` (a column of that name is replaced)."""
    keep = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            got = np.zeros(batch.num_rows)
            for a, b in chunks(offsets):
                got[a:b] = model.scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got)], names=[*keep, "score"])

    schema = docs.select(*keep).selectExpr("*", "0D score").schema
    return docs.select(F.lower(text_col).alias("_text"), *keep).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = fit(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return score(docs, model).select(
        "doc_id", (split_remainder("doc_id", LEARN_MOD) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
