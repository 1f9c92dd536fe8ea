"""Segmentation lattices of many short byte strings ("units") over a fixed public piece vocabulary.

A unit of ``n`` bytes has ``n + 1`` nodes; an edge is a piece of the vocabulary that stands there, or, where
no piece covers the next character, that character as its bytes (id -1). A blank in the text is the
vocabulary's word mark. All units of a chunk are handled together, one step of length or depth at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

TOKENIZERS = "/opt/tokenizers"  # default folder of the public vocabulary files
PIECE_MODEL = "piece_bpe_32k.model"
MAX_UNIT = 40                   # bytes; longer units are cut, which bounds the products' range
_SLOT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Piece bytes (concatenated), ids, kinds, and a trie of (node, byte) -> node in hashed slots."""
    data: np.ndarray
    offsets: np.ndarray
    byte_ids: np.ndarray
    keys: np.ndarray
    children: np.ndarray
    piece_of: np.ndarray
    slots: list[np.ndarray]
    longest: int
    crossed: np.ndarray  # (byte, next byte): do they stand side by side in a piece?
    first: np.ndarray    # node of each byte
    second: np.ndarray   # node of each byte and next byte

    inner: np.ndarray    # has a node children?

    @cached_property
    def pieces(self) -> pa.Array:
        """The bytes of every id."""
        buffers = [None, pa.py_buffer(self.offsets.astype(np.int32).tobytes()), pa.py_buffer(self.data.tobytes())]
        return pa.Array.from_buffers(pa.binary(), self.size, buffers)

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def open_cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte: does a character start there that no piece can join to the byte before it?"""
        out = (data & 0xC0) != 0x80
        out[1:] &= ~self.crossed[data[:-1], data[1:]]
        return out

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by its byte, -1 where there is none."""
        key = (node << 8 | byte).view(np.uint64)
        out, rest = np.full(len(key), -1, np.int64), np.arange(len(key))
        for salt, table in enumerate(self.slots):
            at = table[_place(key, salt, len(table))]
            hit = self.keys[at] == key
            out[rest[hit]] = self.children[at[hit]]
            more = np.flatnonzero(~hit & (at < len(self.keys) - 1))  # only a key whose slot another one took stands in the next
            key, rest = key[more], rest[more]
        return out


def _place(key: np.ndarray, salt: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (key + np.uint64(salt)) * _SLOT
    return (h >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def load_vocabulary(folder: str = TOKENIZERS, name: str = PIECE_MODEL) -> Vocabulary:
    """Read the piece model on the driver; tasks get the arrays."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
    n = model.get_piece_size()
    texts, byte_ids, usable = [], np.full(256, -1, np.int64), []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace("▁", " ").encode())
            usable.append(i)
    return build_vocabulary(texts, usable, byte_ids)


def build_vocabulary(texts: list[bytes], usable: list[int], byte_ids: np.ndarray) -> Vocabulary:
    """A vocabulary from the bytes of every id, the ids that are ordinary pieces, and the ids of single bytes."""
    trie, piece_of = {}, [-1]
    crossed = np.zeros((256, 256), bool)
    for i in usable:
        node = 0
        crossed[list(texts[i][:-1]), list(texts[i][1:])] = True
        for byte in texts[i]:
            key = node << 8 | byte
            if key not in trie:
                trie[key] = len(piece_of)
                piece_of.append(-1)
            node = trie[key]
        piece_of[node] = i
    keys = np.array([*trie, 2**63], np.uint64)  # the last key is in no slot: it marks empty ones
    children = np.array([*trie.values(), -1], np.int64)
    slots, rest, size = [], np.arange(len(trie)), 1 << 20
    while len(rest):
        table = np.full(size, len(trie), np.int32)
        place = _place(keys[rest], len(slots), size)
        table[place] = rest
        slots.append(table)
        rest = rest[table[place] != rest]
        size = max(1 << 10, size >> 3)
    first, second = np.full(256, -1, np.int64), np.full((256, 256), -1, np.int64)
    for byte in range(256):
        first[byte] = trie.get(byte, -1)
        if first[byte] >= 0:
            second[byte] = [trie.get(int(first[byte]) << 8 | after, -1) for after in range(256)]
    inner = np.zeros(len(piece_of), bool)
    inner[[key >> 8 for key in trie]] = True
    return Vocabulary(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
                      byte_ids, keys, children, np.array(piece_of), slots, max(map(len, texts)), crossed, first, second, inner)


_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:0xF8] = 2, 3, 4


@dataclass
class Lattice:
    """Edges of all units, sorted by source node; node = byte position + number of the unit."""
    src: np.ndarray
    dst: np.ndarray
    piece: np.ndarray
    first_node: np.ndarray  # of each unit
    last_node: np.ndarray
    depth: np.ndarray       # of each edge's source within its unit
    to_end: np.ndarray      # bytes from each edge's source to the unit's end


def build_lattice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Lattice:
    """The lattice of the units ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    unit = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][unit] if n else np.zeros(0, np.int64)
    one_char = np.minimum(_CHAR_BYTES[data], end - np.arange(n))
    covered = np.zeros(n, bool)
    at, node, left = np.arange(n), v.first[data], end - np.arange(n)
    number, found = np.zeros(n, np.int64), []
    for k in range(1, v.longest + 1):
        if k > 1:
            live = np.flatnonzero(v.inner[node] & (left >= k))
            at, left = at[live], left[live]
            node = v.second[data[at], data[at + 1]] if k == 2 else v.step(node[live], data[at + k - 1])
        live = np.flatnonzero(node >= 0)
        if not len(live):
            break
        at, node, left = at[live], node[live], left[live]
        got = v.piece_of[node]
        whole = np.flatnonzero(got >= 0)
        here = at[whole]
        number[here] += 1
        found.append((here, k, got[whole]))
        if k <= 4:  # no character has more bytes
            covered[here[one_char[here] == k]] = True
    bare = np.flatnonzero(~covered)
    number[bare] += 1
    found.append((bare, one_char[bare], -1))
    place = np.cumsum(number) - number  # of each byte's next edge
    src = np.repeat(np.arange(n), number)
    length, piece = np.empty(len(src), np.int64), np.empty(len(src), np.int64)
    for here, size, ids in found[::-1]:  # long pieces first
        length[place[here]], piece[place[here]] = size, ids
        place[here] += 1
    numbers = np.arange(len(offsets) - 1)
    return Lattice(src + unit[src], src + unit[src] + length, piece, offsets[:-1] + numbers, offsets[1:] + numbers,
                   src - offsets[:-1][unit[src]], end[src] - src)


def by_step(step: np.ndarray) -> list[np.ndarray]:
    """Edge numbers grouped by ``step``, ascending."""
    most = step.max(initial=-1)
    order = np.argsort(step.astype(np.uint16) if most < 1 << 16 else step, kind="stable")  # two bytes: sorted by digits
    cuts = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=most + 1))])
    return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def forward(lat: Lattice, weight: np.ndarray) -> np.ndarray:
    """Sum over all ways to each node of the product of edge weights (columns are independent models)."""
    alpha = np.zeros((lat.last_node.max(initial=-1) + 1,) + weight.shape[1:])
    alpha[lat.first_node] = 1
    for e in by_step(lat.depth):  # edges of one depth never share a target
        alpha[lat.dst[e]] += alpha[lat.src[e]] * weight[e]
    return alpha


def backward(lat: Lattice, weight: np.ndarray) -> np.ndarray:
    """Sum over all ways from each node to its unit's end."""
    beta = np.zeros((lat.last_node.max(initial=-1) + 1,) + weight.shape[1:])
    beta[lat.last_node] = 1
    for e in by_step(lat.to_end):
        if len(e):
            src = lat.src[e]
            starts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
            beta[src[starts]] = np.add.reduceat(weight[e] * beta[lat.dst[e]], starts, axis=0)
    return beta


def log_backward(lat: Lattice, log_weight: np.ndarray) -> np.ndarray:
    """Logarithms of ``backward``'s sums, for units of any length."""
    beta = np.full(lat.last_node.max(initial=-1) + 1, -np.inf)
    beta[lat.last_node] = 0
    for e in by_step(lat.to_end):
        if len(e):
            src = lat.src[e]
            starts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
            beta[src[starts]] = np.logaddexp.reduceat(log_weight[e] + beta[lat.dst[e]], starts)
    return beta
