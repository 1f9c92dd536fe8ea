"""Operator 2, benchmark decontamination by greedy string tiling.

Seeds: runs of ``MIN_TILE`` words of every benchmark item are hashed; documents are scanned for them, and
a (document, item) pair that shares at least one seed goes on; only then do its two texts meet. Each pair is tiled:
the longest matches of unmarked words are found by Karp-Rabin hashes of running length, which falls from match to
match, marked without overlap, and so on down to ``MIN_TILE`` words. Coverage is the marked share of the item's
words, in whatever order they stand in the document; a document with coverage of ``COVERAGE`` or more of any item
is contaminated.

Words are runs between blanks, A-Z as a-z. An item shorter than ``MIN_TILE`` words matches as one run.
The seed table is held by every task only if its number of rows is below ``SEED_ROWS``; a larger one is
joined by shuffle, and tasks then hold a bitmap of ``SEED_BITS`` that keeps most runs without a seed out of it.
What is held, sent and tiled is in proportion to the texts: no words travel with seeds.

Defined results: null or empty texts share nothing; items without words are skipped; repeated items are one, and
items that share an id are tiled each and answer under it; documents are told apart by id and a 128-bit hash of their
text, so rows with a null id, or an id shared by several texts, have each their own result, and rows equal in both
have the same; an empty benchmark leaves every document clean; only ids and texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import in_files, stored, table
from civicflow.llm.words import chunks, mix, run_hashes, text_buffer, word_hashes, word_spans

MIN_TILE = 5
COVERAGE = 0.6
SEED_ROWS = 500_000  # 8 bytes each: at most 4 MB in a task
SEED_BITS = 1 << 26  # of the bitmap for larger seed tables: 8 MB in a task
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers have inverses modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def texts_as_words(column):
    """The word hashes of each row of an Arrow text column."""
    data, offsets = text_buffer(column)
    for a, b in chunks(offsets):
        part, spans = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, ptr = word_spans(part, spans)
        hashes = word_hashes(part, starts, ends)
        for lo, hi in zip(ptr[:-1], ptr[1:]):
            yield hashes[lo:hi]


class _Side:
    """The words of one text that may still be in a match: their places, prefix hashes and marks."""

    def __init__(self, words: np.ndarray, shared: np.ndarray):
        self.place = np.flatnonzero(shared)
        self.words = words[self.place]
        self.free = np.ones(len(self.place), bool)
        powers = np.cumprod(np.append(np.uint64(1), np.full(max(len(self.place) - 1, 0), _BASE)))[:len(self.place)]
        self.back = np.cumprod(np.append(np.uint64(1), np.full(len(self.place), _INVERSE)))
        self.sums = np.append(np.uint64(0), np.cumsum(mix(self.words) * powers))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the runs of ``n`` words that stand side by side and are unmarked.

        Marked stretches are never shorter than ``n``, so a run with unmarked ends is unmarked.
        """
        last = np.arange(n - 1, len(self.place))
        at = last - (n - 1)
        at = at[(self.place[last] - self.place[at] == n - 1) & self.free[at] & self.free[last]]
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def _covered(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    change = np.zeros(size + n + 1, np.int64)
    change[hits] += 1
    change[hits + n] -= 1
    return np.cumsum(change)[:size] > 0


def tiles(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (item start, document start, length), longest first.

    Running Karp-Rabin: prefix sums give the hash of every run of any length at once. The longest length at which
    unmarked runs of both sides agree is found by bisection (a match contains matches of every smaller length);
    all matches of that length are marked, ties in order of item, then document position; the length falls to
    that of the next match. Equal 64-bit word hashes count as equal words; matches are checked word by word.
    """
    min_tile = max(1, min(min_tile, len(item)))
    hi, hd = run_hashes(item, min_tile), run_hashes(doc, min_tile)
    a = _Side(item, _covered(np.flatnonzero(np.isin(hi, hd)), min_tile, len(item)))
    b = _Side(doc, _covered(np.flatnonzero(np.isin(hd, hi)), min_tile, len(doc)))
    out, most = [], min(len(a.place), len(b.place))

    def agree(n):
        (ia, ha), (ib, hb) = a.runs(n), b.runs(n)
        both_a, both_b = np.isin(ha, hb), np.isin(hb, ha)
        return ia[both_a], ha[both_a], ib[both_b], hb[both_b]

    while most >= min_tile:
        low, high, found = min_tile, most, None
        while low <= high:  # the longest length with a match, if any
            n = (low + high + 1) // 2
            got = agree(n)
            if len(got[0]):
                found, low = (n, got), n + 1
            else:
                high = n - 1
        if found is None:
            return out
        n, (ia, ha, ib, hb) = found
        order = np.argsort(hb, kind="stable")
        keys, first = np.unique(hb[order], return_index=True)
        upto = np.append(first[1:], len(hb)).tolist()
        first = first.tolist()
        for i, k in zip(ia.tolist(), np.searchsorted(keys, ha).tolist()):
            if not (a.free[i] and a.free[i + n - 1]):
                continue
            at = first[k]
            while at < upto[k]:
                j = int(ib[order[at]])
                if b.free[j] and b.free[j + n - 1]:
                    if (a.words[i:i + n] == b.words[j:j + n]).all():
                        a.free[i:i + n] = b.free[j:j + n] = False
                        out.append((int(a.place[i]), int(b.place[j]), n))
                        break
                    at += 1
                else:  # marked for good
                    at += 1
                    first[k] = at
        most = n - 1
    return out


def _key(text):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _items(benchmark: DataFrame, id_col: str, text_col: str, files: int | None = None) -> DataFrame:
    """(item, item_id, item_text): the distinct items, each with a number."""
    items = (benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("item_text"))
             .where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct())
    return stored(in_files(items, files).select(F.monotonically_increasing_id().alias("item"), "item_id", "item_text"))


def _seeds(items: DataFrame) -> DataFrame:
    """(item, seed, size): one row a distinct seed of each item, with its number of words."""
    def run(batches):
        for batch in batches:
            ids, seed, size = [], [], []
            for i, w in zip(batch.column(0).to_pylist(), texts_as_words(batch.column(1))):
                n = min(MIN_TILE, len(w))
                mine = np.unique(run_hashes(w, n)).view(np.int64)
                ids.append(np.full(len(mine), i, np.int64))
                seed.append(mine)
                size.append(np.full(len(mine), n, np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, seed, size)],
                                                 names=["item", "seed", "size"])
    return items.select("item", "item_text").mapInArrow(run, "item long, seed long, size int")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed's place among ``SEED_BITS``; at most ``SEED_BITS / 64`` rows reach the driver."""
    place = F.pmod("seed", F.lit(SEED_BITS))
    rows = (seeds.select(place.alias("p")).groupBy(F.expr("p div 64").cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas())
    out = np.zeros(SEED_BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def shared_seed_pairs(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str,
                      seed_rows: int = SEED_ROWS) -> DataFrame:
    """(id, key, item): documents with every item that shares a seed with them; ``key`` is the text's hash."""
    known = seeds.select("seed").distinct()
    held = known.limit(seed_rows + 1).toPandas()["seed"].to_numpy()
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most MIN_TILE numbers
    small = len(held) <= seed_rows
    table_of_seeds = np.sort(held.view(np.uint64)) if small else None
    bits = None if small else _bitmap(known)

    def scan(batches):
        for batch in batches:
            rows, found = [], []
            for r, w in enumerate(texts_as_words(batch.column(2))):
                runs = [run_hashes(w, n) for n in sizes]
                runs = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
                if bits is not None:
                    place = (runs % np.uint64(SEED_BITS)).astype(np.int64)
                    runs = runs[(bits[place >> 6] >> (place & 63)) & 1 == 1]
                elif len(table_of_seeds):
                    at = np.minimum(np.searchsorted(table_of_seeds, runs), len(table_of_seeds) - 1)
                    runs = runs[table_of_seeds[at] == runs]
                if len(runs):
                    rows.append(r)
                    found.append(np.unique(runs).view(np.int64))
            mine = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(found, pa.list_(pa.int64()))],
                                             names=["id", "key", "seeds"])

    rows = (docs.select(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("key"), F.col(text_col).alias("text"))
            .where(F.col("text").isNotNull()).mapInArrow(scan, "id long, key binary, seeds array<long>"))
    items = seeds.select("item", "seed")
    return (rows.select("id", "key", F.explode("seeds").alias("seed")).join(items if small else items.hint("merge"), "seed")
            .select("id", "key", "item").distinct())


def tiled_coverage(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", files: int | None = None) -> DataFrame:
    """(id, key, item_id, coverage, n_tiles, longest) of every pair that shares a seed. ``files``: see ``frames.in_files``."""
    items = _items(benchmark, item_col, item_text, files)
    pairs = stored(shared_seed_pairs(docs, _seeds(items), id_col, text_col), files)
    named = pairs.join(items, "item").select("id", "key", "item_id", "item_text")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), _key(text_col).alias("h"), F.col(text_col).alias("text"))
    texts = (texts.join(pairs.select("id", "key").distinct(), F.col("doc").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")))
             .select("doc", "h", "text").dropDuplicates(["doc", "h"]))

    def tile(batches):
        for batch in batches:
            cover, number, longest = [], [], []
            for item, doc in zip(texts_as_words(batch.column(3)), texts_as_words(batch.column(4))):
                got = tiles(item, doc)
                cover.append(sum(n for _, _, n in got) / len(item))
                number.append(len(got))
                longest.append(max((n for _, _, n in got), default=0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(cover, pa.float64()), pa.array(number, pa.int32()), pa.array(longest, pa.int32())],
                names=["id", "key", "item_id", "coverage", "n_tiles", "longest"])

    return (named.join(texts, F.col("doc").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")))
            .select("id", "key", "item_id", "item_text", "text")
            .mapInArrow(tile, "id long, key binary, item_id long, coverage double, n_tiles int, longest int"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  coverage: float = COVERAGE, files: int | None = None) -> DataFrame:
    """One row a contaminated document: id and key, its most covered item (ties: smallest id) and that coverage."""
    found = tiled_coverage(docs, benchmark, id_col, text_col, files=files).where(F.col("coverage") >= coverage)
    best = found.groupBy("id", "key").agg(
        F.min(F.struct((-F.col("coverage")).alias("c"), F.col("item_id"))).alias("best"),
        F.countDistinct("item_id").alias("n_items"))
    return best.select("id", "key", F.col("best.item_id").alias("item_id"),
                       (-F.col("best.c")).alias("coverage"), F.col("n_items").cast("int"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, n_items) of every document."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    hit = contamination(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return (docs.select("doc_id", _key("text").alias("_key"))
            .join(hit, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
            .select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id",
                    F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).alias("n_items")))
