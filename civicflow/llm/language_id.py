"""Operator 3, language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of a fixed public vocabulary. A letter run's probability
is the sum over all its segmentations of the product of piece probabilities (forward algorithm on the
lattice), a text's the product over its letter runs; the language with the largest is predicted, and the
score is its share of the sum over languages. Piece probabilities are learnt by expectation-maximisation:
expected piece counts come from forward and backward sums.

Learning takes a bounded sample, ``LEARN_DOCS`` learning rows a language chosen by hash of the id among
texts of at most ``LEARN_BYTES`` bytes; scoring reads whole texts of all rows. Texts are lower-cased.
Defined results: texts that are null or have no letter get ``und`` with score 0; without learning rows
all texts get it; ties go to the first language in order; rows with null lang are scored but not learnt;
an empty table gives an empty result; lang, source and id are never inputs of a prediction. More than
``MAX_LANGS`` languages are refused with an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import split_remainder, table
from civicflow.llm.lattice import MAX_UNIT, TOKENIZERS, Vocabulary, backward, build_lattice, forward, load_vocabulary
from civicflow.llm.words import chunks, cut_spans, gather_spans, span_hashes, text_buffer

LEARN_MOD, HELD_OUT = 4, 2
LEARN_DOCS, LEARN_BYTES = 200, 20_000
MAX_LANGS = 500
STEPS = 4
SMOOTH = 0.05          # added to every expected count
OUTSIDE = np.exp(-14.)  # weight of a character that no piece covers

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of letters (ASCII letters and bytes above ASCII), cut at MAX_UNIT - 1."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1]))) if len(data) else np.zeros(0, int)
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1 if len(data) else np.zeros(0, int)
    starts, ends = cut_spans(starts, ends, MAX_UNIT - 1)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def distinct_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(unit of each span, bytes and offsets of the distinct units with a leading blank)."""
    unit, found = pd.factorize(span_hashes(data, starts, ends))
    first = np.zeros(len(found), np.int64)
    first[unit[::-1]] = np.arange(len(unit))[::-1]
    units, offsets = gather_spans(data, starts[first], ends[first])
    return unit, np.insert(units, offsets[:-1], 32), offsets + np.arange(len(offsets))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (pieces + 1, languages); the last row is for characters outside
    vocabulary: Vocabulary

    def log_likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probability of each row's letter runs in each language, segmentations summed out."""
        starts, ends, row = letter_runs(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if len(starts):
            unit, units, unit_offsets = distinct_units(data, starts, ends)
            lat = build_lattice(self.vocabulary, units, unit_offsets)
            log_p = np.log(forward(lat, self.weights[lat.piece])[lat.last_node])
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(row, log_p[unit, k], minlength=len(out))
        return out


def learn(vocabulary: Vocabulary, texts: list[str], langs: list[str], steps: int = STEPS) -> LanguageModel:
    """Expectation-maximisation of the piece probabilities of each language."""
    names = sorted(set(langs))
    weights = np.full((vocabulary.size + 1, len(names)), 1 / vocabulary.size)
    weights[-1] = OUTSIDE
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    starts, ends, row = letter_runs(data, offsets)
    if not len(starts):
        return LanguageModel([], weights[:, :0], vocabulary)
    unit, units, unit_offsets = distinct_units(data, starts, ends)
    lang_of = np.array([names.index(x) for x in langs])[row]
    counts = np.zeros((len(unit_offsets) - 1, len(names)))
    np.add.at(counts, (unit, lang_of), 1)
    lat = build_lattice(vocabulary, units, unit_offsets)
    unit_of_edge = np.searchsorted(lat.first_node, lat.src, side="right") - 1
    for _ in range(steps):
        w = weights[lat.piece]
        alpha, beta = forward(lat, w), backward(lat, w)
        share = alpha[lat.src] * w * beta[lat.dst] * (counts / alpha[lat.last_node])[unit_of_edge]
        for k in range(len(names)):
            expected = np.bincount(lat.piece[lat.piece >= 0], share[lat.piece >= 0, k], minlength=vocabulary.size) + SMOOTH
            weights[:-1, k] = expected / expected.sum()
    return LanguageModel(names, weights, vocabulary)


def fit(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """Learn from the bounded sample described above."""
    rows = (docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"), F.col(lang_col).alias("lang"))
            .where(F.col("lang").isNotNull() & (split_remainder("id", LEARN_MOD) != HELD_OUT)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return learn(vocabulary, [], [])
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, LEARN_DOCS / r["n"])))])
    chance = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = (rows.where((chance < F.element_at(share, F.col("lang"))) & (F.octet_length("text") <= LEARN_BYTES))
              .select("id", "text", "lang").toPandas().sort_values(["lang", "id"]))
    return learn(vocabulary, list(sample["text"]), list(sample["lang"]))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``lang_pred`` and ``score``."""
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            lettered = np.array(batch.column(1).to_numpy(zero_copy_only=False), bool) & bool(model.langs)
            name, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for a, b in chunks(offsets) if model.langs else ():
                got = model.log_likelihoods(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                best = got.argmax(axis=1)
                name[a:b] = np.array(model.langs, object)[best]
                score[a:b] = 1 / np.exp(got - got.max(axis=1, keepdims=True)).sum(axis=1)
            name[~lettered], score[~lettered] = "und", 0
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(name, pa.string()), pa.array(score)],
                                             names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).selectExpr("*", "'' lang_pred", "0D score").schema
    return (docs.select(F.lower(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
                        .alias("_lettered"), *keep).mapInArrow(run, schema))


def op3_language_id(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = fit(docs, load_vocabulary(tokenizers))
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", (split_remainder("doc_id", LEARN_MOD) == HELD_OUT).alias("held_out"), "lang_pred", "score"))
