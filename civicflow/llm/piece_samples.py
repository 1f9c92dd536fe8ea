"""Operator 7, sampled piece segmentations: Gumbel top-k without replacement over the segmentation lattice.

Pieces come from a fixed public vocabulary with weights 1 / (rank + RANK_OFFSET) by their rank in it (the
vocabulary is not trained). A text is cut before blanks and around newlines, and where that leaves more than
``MAX_UNIT`` bytes before any character, into units, but only at places that no piece of the vocabulary can
cross; so the units' lattices in a row are the text's lattice, and its paths are the segmentations. Units have
no greatest length (the sums are logarithms); memory grows with the longest.

Perturbed A*: the search keeps regions of paths (a fixed beginning, then a first step unlike a known
path's) in order of their perturbed log mass. A region's mass is exact, because the sums over all
completions (the heuristic) are known from the backward pass, and a part's Gumbel value is truncated at its
parent's. The best region gives the next sample: its first step is drawn by share of mass, the rest
freely, and what remains of it splits into new regions. The k first paths are therefore a sample of
k distinct segmentations without replacement in order of perturbed log probability, and

    inclusion = 1 - exp(-exp(log_prob - kappa)),    kappa = the (k + 1)-th perturbed value

(1 if all segmentations were drawn). All draws are hashes of seed, row id, sample and place, so a row's
result depends on nothing else. Decoding a sample gives the text back byte by byte: characters outside the
vocabulary become byte pieces, and a blank is the word mark (the mark itself in a text becomes bytes).

Defined results: null and empty texts have one sample without pieces (log_prob 0, inclusion 1); texts with
fewer than k segmentations have all of them; texts of any length are read whole; a null id counts as a
key of its own; repeated rows have equal results; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.frames import table
from civicflow.llm.lattice import MAX_UNIT, TOKENIZERS, Vocabulary, build_lattice, log_backward, load_vocabulary
from civicflow.llm.words import chunks, gather_spans, mix, span_hashes, text_buffer

SAMPLES = 3
SEED = 17
OUT_IDS = 500_000  # ids in one output batch
CHUNK = 1 << 18  # text bytes whose distinct units share one lattice
RANK_OFFSET = 10
OUTSIDE = np.exp(-13.)  # weight of a character outside the vocabulary


def piece_weights(v: Vocabulary) -> np.ndarray:
    """Normalised weight of each id by rank; the last entry is for characters outside."""
    w = 1 / (np.arange(v.size) + RANK_OFFSET)
    return np.append(w / w.sum(), OUTSIDE)


def uniform(key: np.ndarray, sample: int, place) -> np.ndarray:
    """Numbers in (0, 1), a hash of row key, sample and place."""
    with np.errstate(over="ignore"):
        h = mix(np.asarray(key, np.uint64) + np.uint64(sample + 1) * np.uint64(0x632BE59BD9B4E019)
                ^ mix(np.asarray(place).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def one_uniform(key: int, sample: int, place: int) -> float:
    """``uniform`` for single draws, from Python integers (its own stream)."""
    x = (key + (sample + 1) * 0x632BE59BD9B4E019 + (place + 1) * 0x9E3779B97F4A7C15) % 2**64
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return (((x ^ (x >> 32)) >> 12) + 0.5) / (1 << 52)


def one_gumbel_below(mass: float, bound: float, u: float) -> float:
    g = mass - math.log(-math.log(u))
    low, high = min(g, bound), max(g, bound)
    return low - math.log1p(math.exp(low - high))


def _choose(shares: list[float], u: float) -> int:
    """The place that ``u`` falls on when the shares stand side by side."""
    at, u = 0, u * sum(shares)
    while at < len(shares) - 1 and u >= shares[at]:
        u -= shares[at]
        at += 1
    return at


def gumbel_below(mass, bound, u):
    """Gumbel values of the log masses, truncated at ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-bound, -(mass - np.log(-np.log(u))))


def log_rest(log_p):
    """log(1 - exp(log_p)), minus infinity where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.where(log_p < -1e-12, np.log(-np.expm1(np.minimum(log_p, -1e-300))), -np.inf)


@dataclass
class Path:
    """A row's sampled path: edges, their start for each unit, and the log probability."""
    edges: np.ndarray
    starts: np.ndarray
    log_prob: float
    perturbed: float


class ChunkSampler:
    """Samples for the rows of one chunk of texts."""

    def __init__(self, v: Vocabulary, weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.v, self.keys = v, keys
        full = np.flatnonzero(np.diff(offsets) > 0)
        data = np.insert(data, offsets[full], 32)  # the blank before a text's first word
        grown = offsets.copy()
        grown[1:] += np.cumsum(np.diff(offsets) > 0)
        self.data, self.offsets = data, grown
        cut = (data == 32) | (data == 10)
        cut[1:] |= data[:-1] == 10
        may = v.open_cuts(data)
        cut &= may
        cut[grown[full]] = True
        starts = np.flatnonzero(cut)
        length = np.diff(np.append(starts, len(data)))
        cut |= may & np.repeat(length > MAX_UNIT, length)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        self.unit_ptr = np.searchsorted(starts, grown)
        self.row = np.repeat(np.arange(len(keys)), np.diff(self.unit_ptr))
        self.begin = starts - grown[self.row]  # of each unit within its row
        self.unit, found = pd.factorize(span_hashes(data, starts, ends))
        first = np.zeros(len(found), np.int64)
        first[self.unit[::-1]] = np.arange(len(self.unit))[::-1]
        self.bytes, unit_offsets = gather_spans(data, starts[first], ends[first])
        lat = build_lattice(v, self.bytes, unit_offsets)
        log_w = np.log(weights)[lat.piece]
        beta = log_backward(lat, log_w)
        self.lat, self.log_chance = lat, np.minimum(log_w + beta[lat.dst] - beta[lat.src], 0)
        self.chance = np.exp(self.log_chance)
        nodes = lat.last_node.max(initial=-1) + 1
        self.edge_ptr = np.concatenate([[0], np.cumsum(np.bincount(lat.src, minlength=nodes))])
        total = np.concatenate([[0], np.cumsum(self.chance)])
        self.upto = total[1:] - total[self.edge_ptr[self.lat.src]]
        self.upto[self.edge_ptr[1:][np.diff(self.edge_ptr) > 0] - 1] = 2  # the last edge takes what is left
        self.first_byte = lat.first_node - unit_offsets[:-1]  # node minus this is a byte of ``bytes``
        # each edge's (first) id, and how many ids more a character outside the vocabulary has
        bare = np.flatnonzero(self.lat.piece < 0)
        unit_of = np.searchsorted(lat.first_node, self.lat.src[bare], side="right") - 1
        self.edge_id = self.lat.piece.astype(np.int32)
        self.edge_id[bare] = v.byte_ids[self.bytes[self.lat.src[bare] - self.first_byte[unit_of]]]
        self.wide = np.zeros(len(self.edge_id), np.int64)
        self.wide[bare] = self.lat.dst[bare] - self.lat.src[bare] - 1

    def walk(self, units: np.ndarray, nodes: np.ndarray, sample: int):
        """Free draws from ``nodes`` to the end of each unit: (edges one unit after another, start of each)."""
        keys, goal = self.keys[self.row[units]], self.lat.last_node[self.unit[units]]
        base = self.begin[units] - self.lat.first_node[self.unit[units]]
        live = np.flatnonzero(nodes < goal)
        steps, number = [], np.zeros(len(units), np.int64)
        here, keys, goal, base = nodes[live], keys[live], goal[live], base[live]
        while len(live):
            u = uniform(keys, sample, base + here)
            edge = self.edge_ptr[here]
            open_ = np.flatnonzero(u >= self.upto[edge])
            while len(open_):
                edge[open_] += 1
                open_ = open_[u[open_] >= self.upto[edge[open_]]]
            steps.append((live, edge))
            number[live] += 1
            here = self.lat.dst[edge]
            on = np.flatnonzero(here < goal)
            live, here, keys, goal, base = live[on], here[on], keys[on], goal[on], base[on]
        starts = np.concatenate([[0], np.cumsum(number)])
        edges = np.empty(starts[-1], np.int64)
        for nth, (who, edge) in enumerate(steps):
            edges[starts[who] + nth] = edge
        return edges, starts

    def _regions(self, units, row_of, edges, starts, before, bound, sample, k):
        """Best ``k`` regions of each row that leave the new path in one of ``units``: (row, value, unit).

        ``before``: log probability of what is fixed ahead of the row's first listed unit.
        """
        log_p = np.add.reduceat(np.append(self.log_chance[edges], 0.0), np.minimum(starts[:-1], len(edges)))
        log_p[starts[:-1] == starts[1:]] = 0
        upto = np.cumsum(log_p)
        head = np.flatnonzero(np.append(True, row_of[1:] != row_of[:-1]))
        size = np.diff(np.append(head, len(row_of)))
        nth = np.repeat(np.arange(len(head)), size)
        ahead = upto - log_p
        ahead += np.repeat(before - ahead[head], size)
        mass = ahead + log_rest(log_p)
        value = gumbel_below(mass, np.repeat(bound, size), uniform(self.keys[row_of], sample + 1000, self.begin[units]))
        left, best = np.where(mass > -np.inf, value, -np.inf), []
        for _ in range(k):  # each row's greatest, the first of equal ones
            at = np.flatnonzero((left == np.repeat(np.maximum.reduceat(left, head), size)) & (left > -np.inf))
            if not len(at):
                break
            best.append(at[np.append(True, nth[at[1:]] != nth[at[:-1]])])
            left[best[-1]] = -np.inf
        best = np.concatenate(best) if best else np.zeros(0, np.int64)
        best = best[np.argsort(nth[best], kind="stable")]
        return row_of[best], value[best], best, ahead, log_p

    def samples(self, k: int) -> list[list[Path]]:
        """Up to ``k`` paths a row, and after them the (k + 1)-th perturbed value as ``self.kappa``."""
        n = len(self.keys)
        units = np.arange(len(self.unit))
        edges, starts = self.walk(units, self.lat.first_node[self.unit], 0) if len(units) else (units, np.zeros(1, int))
        out, heaps = [[] for _ in range(n)], [[] for _ in range(n)]
        rows = np.unique(self.row)
        u = uniform(self.keys, 500, np.zeros(n))
        top = -np.log(-np.log(u))
        for r in np.setdiff1d(np.arange(n), rows):
            out[r].append(Path(np.zeros(0, np.int64), np.zeros(1, np.int64), 0.0, top[r]))
        if len(rows):
            found = self._regions(units, self.row, edges, starts, np.zeros(len(rows)), top[rows], 0, k)
            ahead, log_p = found[3:]
            for r in rows.tolist():
                a, b = self.unit_ptr[r], self.unit_ptr[r + 1]
                out[r].append(Path(edges[starts[a]:starts[b]], starts[a:b + 1] - starts[a], ahead[b - 1] + log_p[b - 1], top[r]))
            for r, value, at in zip(*(x.tolist() for x in found[:3])):
                # leave path 0 in unit ``at`` at or after its edge 0
                heapq.heappush(heaps[r], (-value, 0, at - int(self.unit_ptr[r]), 0, None, ahead[at]))
        for s in range(1, k):
            todo = [(r, self._leave(heaps[r], out[r], r, s)) for r in rows.tolist() if heaps[r]]
            if not todo:
                break
            counts = [self.unit_ptr[r + 1] - self.unit_ptr[r] - t[1] for r, t in todo]
            units = np.concatenate([np.arange(self.unit_ptr[r] + t[1], self.unit_ptr[r + 1]) for r, t in todo])
            heads = np.cumsum([0, *counts[:-1]])
            nodes = self.lat.first_node[self.unit[units]]
            nodes[heads] = [self.lat.dst[t[3]] for _, t in todo]
            edges, starts = self.walk(units, nodes, s)
            before, bound = np.array([t[4] for _, t in todo]), np.array([t[5] for _, t in todo])
            found = self._regions(units, self.row[units], edges, starts, before, bound, s, k)
            ahead, log_p = found[3:]
            fixed = {}
            for (r, (base, i, j, alt, _, value)), at, c in zip(todo, heads.tolist(), counts):
                old = out[r][base]
                keep = old.edges[:old.starts[i] + j]
                new, local = edges[starts[at]:starts[at + c]], starts[at:at + c + 1] - starts[at]
                inside = j + 1
                path_starts = np.concatenate([old.starts[:i + 1], old.starts[i] + inside + local[1:]])
                out[r].append(Path(np.concatenate([keep, [alt], new]), path_starts,
                                   ahead[at + c - 1] + log_p[at + c - 1], value))
                fixed[r] = (at, i, inside)
            for r, value, at in zip(*(x.tolist() for x in found[:3])):
                head, i, inside = fixed[r]
                heapq.heappush(heaps[r], (-value, s, i + at - head, inside if at == head else 0, None, ahead[at]))
        self.kappa = [-h[0][0] if h else -np.inf for h in heaps]
        return out

    def _leave(self, heap, paths, r, s):
        """Pop the best region and choose its first step: (path, unit, edge place, edge, log mass to it, value).

        A region of a unit is cut into one a place of the unit's edges first; a region of a place excludes the
        edges known to be taken there, and what remains after the new one is a region again.
        """
        minus, base, i, j, taken, ahead = heapq.heappop(heap)
        value, path, key = -minus, paths[base], int(self.keys[r])
        if taken is None:
            own = path.edges[path.starts[i] + j:path.starts[i + 1]].tolist()
            reach, mass = [], []
            for e in own:
                rest = 1 - self.chance[e]
                reach.append(ahead)
                mass.append(ahead + math.log(rest) if rest > 1e-12 else -math.inf)
                ahead += self.log_chance[e]
            most = max(mass)
            pick = _choose([math.exp(m - most) for m in mass], one_uniform(key, 2000 + s, 0))
            for x, m in enumerate(mass):
                if x != pick and m > -math.inf:
                    t = one_gumbel_below(m, value, one_uniform(key, 2000 + s, x + 10))
                    heapq.heappush(heap, (-t, base, i, j + x, (own[x],), reach[x]))
            j, taken, ahead = j + pick, (own[pick],), reach[pick]
        node = self.lat.src[taken[0]]
        others = [e for e in range(self.edge_ptr[node], self.edge_ptr[node + 1]) if e not in taken]
        share = [self.chance[e] for e in others]
        at = _choose(share, one_uniform(key, 2000 + s, 1))
        alt, left = others[at], sum(share) - share[at]
        if len(others) > 1 and left > 0:
            t = one_gumbel_below(ahead + math.log(left), value, one_uniform(key, 2000 + s, 2))
            heapq.heappush(heap, (-t, base, i, j, (*taken, alt), ahead))
        return base, i, j, alt, ahead + self.log_chance[alt], value

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path's edges; a character outside the vocabulary gives its bytes' ids."""
        wide = self.wide[edges]
        if not wide.any():
            return self.edge_id[edges]
        src, number = self.lat.src[edges], 1 + wide
        place = np.repeat(src, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        unit = np.searchsorted(self.lat.first_node, place, side="right") - 1
        as_bytes = self.v.byte_ids[self.bytes[place - self.first_byte[unit]]]
        return np.where(np.repeat(self.lat.piece[edges] < 0, number), as_bytes,
                        np.repeat(self.edge_id[edges], number)).astype(np.int32)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of piece ids: their bytes without the first blank."""
    found = v.pieces.take(pa.array(ids)).buffers()[2]
    return found.to_pybytes()[1:] if found is not None else b""


def sampled_rows(v: Vocabulary, weights: np.ndarray, column, row_ids, k: int, seed: int):
    """(row, sample, ids, log_prob, inclusion, original bytes) for each sample of each row of a text column."""
    data, offsets = text_buffer(column)
    keys = np.array([hash_key(x, seed) for x in row_ids], np.uint64)
    for a, b in chunks(offsets, CHUNK):
        part, spans = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        sampler = ChunkSampler(v, weights, part, spans, keys[a:b])
        for r, paths in enumerate(sampler.samples(k)):
            for s, p in enumerate(paths):
                kappa = sampler.kappa[r]
                chance = -np.expm1(-np.exp(min(p.log_prob - kappa, 700.0))) if np.isfinite(kappa) else 1.0
                yield a + r, s, sampler.ids(p.edges), p.log_prob, chance, part[spans[r]:spans[r + 1]]


def hash_key(row_id, seed: int) -> int:
    """A row's 64-bit key from its integer id (null: a key of its own) and the seed."""
    x = 0x5851F42D4C957F2D if row_id is None else row_id
    return (x * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93 + 1) % 2**64


def sample_segmentations(docs: DataFrame, v: Vocabulary, k: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id",
                         text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row a sample: id, sample, n_pieces, log_prob, inclusion, and ``ids``.

    With ``digest`` the ids' CRC-32 (as little-endian 32-bit numbers) and whether they decode to the text
    stand in place of ``ids``.
    """
    weights = piece_weights(v)
    tail = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>"

    names = ["id", "sample", "n_pieces", "log_prob", "inclusion", *(("ids_crc32", "round_trip") if digest else ("ids",))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(),
             *((pa.int64(), pa.bool_()) if digest else (pa.list_(pa.int32()),))]

    def run(batches):
        for batch in batches:
            row_ids = batch.column(0).to_pylist()
            rows, held = [], 0
            for r, s, ids, log_prob, chance, text in sampled_rows(v, weights, batch.column(1), row_ids, k, seed):
                more = ((zlib.crc32(ids.astype("<i4").tobytes()), decode(v, ids) == text.tobytes()) if digest else (ids,))
                rows.append((row_ids[r], s, len(ids), float(log_prob), float(chance), *more))
                held += len(ids) + 100
                if held > OUT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id long, sample int, n_pieces int, log_prob double, inclusion double, {tail}")
            .withColumnRenamed("id", id_col))


def op7_piece_samples(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every sample of every document as a digest."""
    return sample_segmentations(table(spark, sf_dir, "documents", ["doc_id", "text"]), load_vocabulary(tokenizers), digest=True)
