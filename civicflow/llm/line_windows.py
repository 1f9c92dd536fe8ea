"""Operator 9, line dedup by overlapping three-line windows.

A window is three consecutive lines that are not blank (lines are cut at newlines and compared without
surrounding blanks). Windows are hashed to 128 bits and counted over all documents; every occurrence of
a repeated window but the first (smallest id, then line position) covers its three lines, and a
document's covered lines, the union over its windows, are removed. The rest keeps its text and order.

A document's window hashes are made once and written; counts are pre-aggregated before their shuffle. Windows
that occur more often than ``HOT`` partitions' shares would make even (so at most ``HOT`` times the shuffle
partitions of them, whatever the input) are matched by broadcast and never dealt by their hash; all others are
ranked where they meet their count. Covered lines are found by one sorted merge a document.

Defined results: a null text stays null, and texts with fewer than three
lines stay as they are; a document whose lines are all covered becomes the empty text; rows with a null
id come first in the order; rows equal in id and text are one document, rows that share an id (or have none) but
not a text are documents of their own, told apart by the text's 128-bit hash; an empty table gives
an empty result; other columns pass through, whatever their names.

With ``fine`` (the pipeline's stage; the query's lines are fixed by its SQL) lines of more than ``LONG`` words
are cut further, by their content alone: after sentences of ``LEAST`` words or more, and what is still longer
than ``LONG`` words at winnowing minima of word hashes, so no part has more. A window is then three such lines
or parts; shared lines of over 50 words hold at least four, so two windows. A run of covered parts counts only
from ``RUN_WORDS`` words (a passage of over 50 words inside a line has that many without its first and last part).
Kept parts stand byte for byte.

With ``groups`` (id, group) documents of one group, such as near copies, do not count against each other: an
occurrence is a later one if the first is in another group, or if its own document has an earlier one. What repeats
between them is left to the step that keeps one of the group. What they share with others is cut from each
where it stands unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.llm.frames import stored, table
from civicflow.llm.words import block_hashes, chunks, mix, odd_constants, span_hashes, text_buffer, word_spans

WINDOW = 3
LONG, LEAST = 16, 8  # most words of a part of a line, fewest of a sentence that ends one
RUN_WORDS = 32       # fewest words of a repeated run of parts that is removed
HOT = 4              # windows that occur more than once in (all windows / HOT / shuffle partitions) are broadcast
HOT_LEAST = 1000     # but only from so many occurrences
_ID, _KEY, _COVERED, _CUT = (f"_line_windows_{x}" for x in ("id", "key", "covered", "cut"))  # names no input column should have


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte places where lines of texts, and parts of long lines, start (each text's first byte too)."""
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data[:-1] == 10) + 1]))
    starts, ends, _ = word_spans(data, offsets)
    if not len(starts):
        return line_starts
    line = np.searchsorted(line_starts, starts, side="right")
    wide = np.bincount(line)[line] > LONG
    here = np.arange(len(starts))
    first = np.append(True, line[1:] != line[:-1])
    after = np.append(False, np.isin(data[ends[:-1] - 1], [33, 46, 63]))  # the word before ends a sentence
    begin = np.maximum.accumulate(np.where(first | after, here, 0))
    cut = first | (after & wide & (here - np.append(0, begin[:-1]) >= LEAST))
    part = np.cumsum(cut)
    if len(starts) >= LONG:
        order = mix(span_hashes(data, starts, ends))
        runs = np.flatnonzero(part[:len(part) - LONG + 1] == part[LONG - 1:])  # runs of LONG words inside a part
        runs = runs[~cut[runs]]  # a part's first word is a cut already
        for at in np.array_split(runs, len(runs) // 100_000 + 1):
            places = at[:, None] + np.arange(LONG - 1, -1, -1)
            cut[at + LONG - 1 - order[places].argmin(axis=1)] = True  # the last of equal ones
    return np.union1d(line_starts, starts[cut & ~first])


def line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte places where lines start, each text's first byte included; an empty last line has none."""
    after = np.flatnonzero(data == 10) + 1
    return np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], after[after < len(data)]]))


class Segments:
    """The lines (or parts) of a chunk of texts that are not blank: span without outer blanks, words, row, line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fine: bool):
        self.data = data
        self.lines = part_starts(data, offsets) if fine else line_starts(data, offsets)
        starts, ends, _ = word_spans(data, offsets)
        head = np.zeros(len(data), np.int32)
        head[self.lines] = 1
        line = np.cumsum(head)[starts] - 1
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.words = np.diff(np.append(first, len(line)))
        self.line, self.begin = line[first], starts[first]
        self.end = ends[first + self.words - 1] if len(first) else self.begin
        self.row = np.searchsorted(offsets, self.begin, side="right") - 1
        self.ptr = np.searchsorted(self.row, np.arange(len(offsets)))

    def window_hashes(self, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, other hash) of each run of ``window`` segments of one text."""
        n = max(len(self.row) - window + 1, 0)
        inside = np.flatnonzero(self.row[:n] == self.row[len(self.row) - n:])
        out = [self.row[inside]]
        for steps in odd_constants(2 * (window + 1), 9).reshape(2, -1):
            h = block_hashes(self.data, self.begin, self.end, steps[0])
            total = np.zeros(len(inside), np.uint64)
            for k in range(window):
                total += h[inside + k] * steps[k + 1]
            out.append(mix(total).view(np.int64))
        return tuple(out)

    def covered(self, rows: np.ndarray, windows: np.ndarray, least_words: int, window: int = WINDOW) -> np.ndarray:
        """Which segments do the windows (numbered within their rows) cover, in runs of ``least_words`` or more?"""
        change = np.zeros(len(self.row) + window + 1, np.int64)
        np.add.at(change, self.ptr[rows] + windows, 1)
        np.add.at(change, self.ptr[rows] + windows + window, -1)
        out = np.cumsum(change)[:len(self.row)] > 0
        if least_words and len(out):
            edge = np.append(True, (out[1:] != out[:-1]) | (self.row[1:] != self.row[:-1]))
            run = np.cumsum(edge) - 1
            out &= np.bincount(run, self.words)[run] >= least_words
        return out


def parts(text: pa.Array) -> pa.Array:
    """The lines, with their newlines, and parts of long lines of each text (none of a null one)."""
    data, offsets = text_buffer(text)
    found = [offsets[a] + part_starts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in chunks(offsets)]
    starts = np.concatenate([*found, offsets[-1:]]).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.tobytes()), pa.py_buffer(data.tobytes()))
    return pa.ListArray.from_arrays(np.searchsorted(starts[:-1], offsets).astype(np.int32), strings)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signed_windows(docs: DataFrame, id_col: str, text_col: str, fine: bool = False) -> DataFrame:
    """(id, key, windows): the two 64-bit hashes of each window of a text, in order; texts without any are left out."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.struct([("h", pa.int64()), ("g", pa.int64())])

    def sign(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in chunks(offsets):
                row, h, g = Segments(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], fine).window_hashes()
                some, at = np.unique(row, return_index=True)
                if len(some):
                    rows = batch.slice(a, b - a).take(pa.array(some))
                    hashes = pa.StructArray.from_arrays([pa.array(h), pa.array(g)], fields=list(kind))
                    windows = pa.ListArray.from_arrays(np.append(at, len(h)).astype(np.int32), hashes)
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), windows], names=["id", "key", "windows"])

    return (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _key(F.col(text_col)).alias("key"), F.col(text_col))
            .mapInArrow(sign, f"id {id_type}, key binary, windows array<struct<h:bigint,g:bigint>>"))


def covering_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fine: bool = False,
                     groups: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """(id, key, covered): the numbers of each document's windows that are later occurrences. ``files``: see ``frames.in_files``."""
    signed = signed_windows(docs, id_col, text_col, fine)
    who = F.struct("id", "key")  # one document; or its group, or a number for documents that have none
    if groups is not None:
        named = groups.toDF("_of", "group").where(F.col("group").isNotNull()).distinct()
        signed = signed.join(named, F.col("id") == F.col("_of"), "left").withColumn("group", F.coalesce("group", F.xxhash64("key")))
        who = F.col("group")
    signed = stored(signed.select("id", "key", "windows", who.alias("who")), files)
    windows = signed.select("id", "key", "who", F.posexplode("windows").alias("at", "w")).select("id", "key", "who", "at", "w.h", "w.g")
    counts = stored(windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), files)
    total = signed.agg(F.sum(F.size("windows")).alias("n")).first()["n"] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(HOT_LEAST, total // (HOT * partitions))  # fewer than HOT * partitions windows can occur more often
    hot = counts.where(F.col("n") > limit).select("h", "g")
    some_hot = hot.count() > 0
    usual = windows.join(F.broadcast(hot), ["h", "g"], "left_anti") if some_hot else windows
    same = Window.partitionBy("h", "g").orderBy(F.asc_nulls_first("id"), "at", "key")
    inside = Window.partitionBy("h", "g", "id", "key").orderBy("at")
    again = lambda df: (df.withColumn("nth", F.dense_rank().over(inside))
                        .where(~F.col("who").eqNullSafe(F.col("first")) | (F.col("nth") > 1)).select("id", "key", "at"))
    later = again(usual.join(counts.where(F.col("n") <= limit).select("h", "g"), ["h", "g"])
                  .withColumn("first", F.first("who").over(same)))
    if some_hot:
        mine = windows.join(F.broadcast(hot), ["h", "g"])
        firsts = stored(mine.groupBy("h", "g").agg(F.min(F.struct("id", "at", "key", "who")).alias("f"))
                        .select("h", "g", F.col("f.who").alias("first")))
        later = later.unionByName(again(windows.join(F.broadcast(firsts), ["h", "g"])))
    return later.groupBy("id", "key").agg(F.collect_list("at").alias("covered"))


def without_covered(text: pa.Array, covered: pa.Array, fine: bool) -> pa.StructArray:
    """(text without its covered lines or parts, their number) of each row; null texts stay null."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    data, offsets = text_buffer(text)
    covered = covered.cast(pa.list_(pa.int64()))
    at, flat = np.asarray(covered.value_lengths().fill_null(0)), np.asarray(covered.flatten())
    ptr = np.concatenate([[0], np.cumsum(at)])
    sizes, removed, kept = np.diff(offsets), np.zeros(len(text), np.int32), []
    for a, b in chunks(offsets):
        part = data[offsets[a]:offsets[b]]
        s = Segments(part, offsets[a:b + 1] - offsets[a], fine)
        gone = s.covered(np.repeat(np.arange(b - a), at[a:b]), flat[ptr[a]:ptr[b]], RUN_WORDS if fine else 0)
        drop = np.zeros(len(s.lines), bool)
        drop[s.line[gone]] = True
        stay = ~np.repeat(drop, np.diff(np.append(s.lines, len(part))))
        removed[a:b] = np.bincount(s.row[gone], minlength=b - a)
        if not fine and len(part):  # a newline stands between lines: one left at the end goes with a removed last line
            for r in np.flatnonzero(removed[a:b]):
                lo, hi = offsets[a + r] - offsets[a], offsets[a + r + 1] - offsets[a]
                if not stay[hi - 1] and part[hi - 1] != 10 and stay[lo:hi].any():
                    stay[lo + np.flatnonzero(stay[lo:hi])[-1]] = False
        kept.append(part[stay])
        sizes[a:b] = np.diff(np.concatenate([[0], np.cumsum(stay)])[offsets[a:b + 1] - offsets[a]])
    out = np.concatenate(kept) if kept else np.zeros(0, np.uint8)
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(text), pa.py_buffer(places.tobytes()), pa.py_buffer(out.tobytes()))
    return pa.StructArray.from_arrays([texts, pa.array(removed)], ["text", "removed"])


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fine: bool = False,
                          groups: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """``docs`` with covered lines removed, plus ``_lines`` (number of lines) and ``_removed`` (of lines, or parts).

    Only texts with covered windows go through Python.
    """
    covered = covering_windows(docs, id_col, text_col, fine, groups, files).select(
        F.col("id").alias(_ID), F.col("key").alias(_KEY), F.col("covered").alias(_COVERED))
    text = F.col(text_col)

    def cut_lines(text: pa.Array, covered: pa.Array) -> pa.Array:
        return without_covered(text, covered, fine)

    cut = F.arrow_udf(cut_lines, T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
    cut = cut.asNondeterministic()  # else a caller's filter on the columns below cuts every text a second time
    hit = F.col(_COVERED).isNotNull()
    return (docs.join(covered, F.col(id_col).eqNullSafe(F.col(_ID)) & (_key(text) == F.col(_KEY)), "left")
            .withColumn(_CUT, cut(F.when(hit, text), F.col(_COVERED)))
            .withColumn("_lines", F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)))
            .withColumn("_removed", F.when(hit, F.col(f"{_CUT}.removed")).otherwise(0))
            .withColumn(text_col, F.when(hit, F.col(f"{_CUT}.text")).otherwise(text))
            .drop(_ID, _KEY, _COVERED, _CUT))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_bytes, text_md5) of every document after line dedup."""
    out = remove_repeated_lines(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"),
                      F.col("_removed").cast("long").alias("n_removed"),
                      F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
s AS (
  SELECT doc_id, list_filter(list_transform(range(len(raw)), lambda i: {'pos': i,
    'line': regexp_replace(raw[i + 1], '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')}), lambda x: x.line <> '') AS ls
  FROM l WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT doc_id, [ls[i].pos, ls[i + 1].pos, ls[i + 2].pos] AS places,
    ls[i].line || chr(10) || ls[i + 1].line || chr(10) || ls[i + 2].line AS h
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM s WHERE len(ls) >= 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, places) AS nth FROM w),
c AS (SELECT doc_id, list(DISTINCT a) AS covered FROM (SELECT doc_id, unnest(places) AS a FROM n WHERE nth > 1) GROUP BY 1),
r AS (
  SELECT l.doc_id, text, raw, covered, CASE WHEN covered IS NULL THEN text ELSE coalesce(array_to_string(
    list_transform(list_filter(range(len(raw)), lambda i: NOT list_contains(covered, i)), lambda i: raw[i + 1]), chr(10)), '') END AS t
  FROM l LEFT JOIN c ON l.doc_id IS NOT DISTINCT FROM c.doc_id)
SELECT doc_id, coalesce(len(raw), 0)::BIGINT AS n_lines, coalesce(len(covered), 0)::BIGINT AS n_removed,
  strlen(t)::BIGINT AS n_bytes, md5(t) AS text_md5 FROM r
"""
