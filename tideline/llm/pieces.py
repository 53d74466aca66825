"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's lattice has a node for each byte and an edge for each vocabulary piece that
matches there; a character without a piece of its own goes through its byte pieces. A
piece weighs ``1 / rank``, to the power ``alpha``; ranks are the vocabulary's own order. Forward filtering
sums the weights of all paths into each node, backward sampling draws edges from the end
with draws seeded by the row key, so a row always gets the same segmentation, on any cluster.

No piece crosses from a word into the blank behind it or holds a line end, so a
text's lattice falls apart at those places; each distinct part of a batch is filtered once
and all its occurrences are sampled together. The vocabulary (some 10**4 pieces, of a size
fixed by its file) is read on the driver and goes to the tasks with the function.

Defined cases: a null text gives null pieces, an empty one an empty list; a null key counts as 0;
repeated rows get equal pieces; a very long text is encoded whole, its long parts node by node; an empty table gives no rows; extra columns are left
out by :func:`encode`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, documents, mix, slice_hashes, text_bytes

MODEL, ALPHA, SEED = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 17
CHUNK_BYTES, LONG_PART, SLOT_BITS = 2 << 20, 1024, 18
_BLANK = "▁"


class Vocabulary:
    """Pieces by hash of every prefix, their weights and their bytes."""

    def __init__(self, pieces: list[bytes | None], byte_ids: list[int], weights: np.ndarray):
        """pieces: the bytes of each id, with a blank for the blank sign; None for ids that never occur in text."""
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        prefixes: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            if p is None or i in set(byte_ids):
                continue
            if b" " in p.lstrip(b" ") or b"\n" in p:
                raise ValueError(f"piece {i} crosses the place where texts are cut")
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], -1)
            prefixes[p] = i
        hashes = np.array([self.hash_of(p) for p in prefixes], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(prefixes.values()), np.int32)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        # slots by scattered upper bits; entries of a slot stand together
        slot = self._slot(self.hashes)
        by_slot = np.argsort(slot, kind="stable")
        self.hashes, self.ids = np.r_[self.hashes[by_slot], np.uint64(0)], np.r_[self.ids[by_slot], np.int32(-2)]
        self.slots = np.searchsorted(slot[by_slot], np.arange((1 << SLOT_BITS) + 1))
        self.most = int(np.diff(self.slots).max()) if len(prefixes) else 0
        # prefixes of one and of two bytes by their bytes
        self.one, self.two = np.full(256, -2, np.int32), np.full(1 << 16, -2, np.int32)
        for p, i in prefixes.items():
            if len(p) == 1:
                self.one[p[0]] = i
            elif len(p) == 2:
                self.two[p[0] << 8 | p[1]] = i
        self.longest = max(map(len, prefixes), default=0)
        self.byte_ids, self.weights = np.array(byte_ids, np.int32), weights
        full = [b"" if p is None else p for p in pieces]
        for b, i in enumerate(byte_ids):
            full[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(full), np.uint8)
        self.size = np.array([len(p) for p in full], np.int64)
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each prefix hash: -1 for a prefix that is no piece, -2 for none."""
        slot = self._slot(h)
        at, end = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(h), -2, np.int32)
        live = np.flatnonzero(at < end)
        for _ in range(self.most):
            place = at[live]
            hit = self.hashes[place] == h[live]
            out[live[hit]] = self.ids[place[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
            if not len(live):
                break
        return out

    @staticmethod
    def hash_of(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * int(BASE) + b + 1) % (1 << 64)
        return h

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) else sp.id_to_piece(i).replace(_BLANK, " ").encode() for i in range(n)]
        byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls(text, [byte[b] for b in sorted(byte)], -alpha * np.log(np.arange(n) + 1.0))


def _edges(v: Vocabulary, data: np.ndarray, left: np.ndarray):
    """(from byte, length, piece) of every edge over ``data``; left: bytes from each one to its part's end."""
    char = (data & 0xC0) != 0x80
    at = np.flatnonzero(char).astype(np.int32)
    width = np.ones(len(data), np.int8)
    width[data >= 0xC0], width[data >= 0xE0], width[data >= 0xF0] = 2, 3, 4
    alone = np.zeros(len(data), bool)
    out = []
    h = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, v.longest + 1):
            go = left[at] >= n
            at, h = at[go], h[go] if n > 2 else h
            if not len(at):
                break
            if n == 1:
                piece = v.one[data[at]]
            elif n == 2:
                a, b = data[at].astype(np.int32), data[at + 1]
                piece = v.two[a << 8 | b]
                h = (a + 1).astype(np.uint64) * BASE + b + np.uint64(1)
            else:
                h = h * BASE + data[at + (n - 1)] + np.uint64(1)
                piece = v.find(h)
            go = piece > -2
            at, h, piece = at[go], h[go] if n > 1 else h, piece[go]
            whole = piece >= 0
            if whole.any():
                out.append((at[whole], np.full(int(whole.sum()), n, np.int32), piece[whole]))
                alone[at[whole][width[at[whole]] == n]] = True
    bare = np.flatnonzero(char & ~alone)
    if len(bare):
        size = np.minimum(width[bare], left[bare]).astype(np.int64)
        at = (np.repeat(bare, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))).astype(np.int32)
        out.append((at, np.ones(len(at), np.int32), v.byte_ids[data[at]]))
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out))


def _filter_part(score: np.ndarray, source: np.ndarray, weight: np.ndarray, into: np.ndarray, root: int, size: int) -> None:
    """The forward scores of one part's nodes, node after node."""
    got = [0.0] + [-math.inf] * size
    cut = into[root : root + size + 2].tolist()
    e0 = cut[0]
    src, w = (source[e0 : cut[-1]] - root).tolist(), weight[e0 : cut[-1]].tolist()
    for i in range(1, size + 1):
        values = [got[src[e]] + w[e] for e in range(cut[i] - e0, cut[i + 1] - e0)]
        top = max(values, default=-math.inf)
        if top > -math.inf:
            got[i] = top + math.log(sum(math.exp(x - top) for x in values))
    score[root : root + size + 1] = got


def _draw_part(ladder: np.ndarray, source: np.ndarray, piece: np.ndarray, into: np.ndarray, root: int, size: int, state: int) -> np.ndarray:
    """One part's pieces, drawn from its end to its begin with the same draws as :func:`sample` takes for short ones."""
    cut = into[root : root + size + 2].tolist()
    e0 = cut[0]
    rungs, src, ids = ladder[e0 : cut[-1]].tolist(), (source[e0 : cut[-1]] - root).tolist(), piece[e0 : cut[-1]].tolist()
    node, out = size, []
    while node > 0:
        u = (state >> 11) / float(1 << 53)
        e = cut[node] - e0
        while rungs[e] <= u:
            e += 1
        out.append(ids[e])
        node = src[e]
        state = _mix_one((state + int(BASE)) & _MASK)
    return np.array(out[::-1], np.int32)


_MASK = (1 << 64) - 1


def _mix_one(x: int) -> int:
    """common.mix for one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def sample(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the texts data[start:end], end to end, and their offsets. keys: uint64 per text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(starts) + 1, np.int64)
    cut = np.zeros(n, bool)
    cut[starts[starts < n]] = True
    cut[1:] |= ((data[1:] == 32) & (data[:-1] != 32)) | (data[1:] == 10) | (data[:-1] == 10)
    cut[0] = True
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], n]
    _, first, part = np.unique(slice_hashes(data, begin, end), return_index=True, return_inverse=True)
    # the bytes of the distinct parts, end to end; a part of b bytes has b + 1 nodes
    size = end[first] - begin[first]
    base = np.cumsum(size) - size
    own = data[np.repeat(begin[first] - base, size) + np.arange(size.sum())]
    which = np.repeat(np.arange(len(first), dtype=np.int32), size)
    left = (np.repeat(base + size, size) - np.arange(len(own))).astype(np.int32)
    at, length, piece = _edges(v, own, left)
    source = at + which[at]
    order = np.argsort(source + length, kind="stable")
    at, length, source, piece = at[order], length[order], source[order], piece[order]
    target = source + length
    weight = v.weights[piece]
    n_nodes = len(own) + len(first)
    into = np.r_[0, np.cumsum(np.bincount(target, minlength=n_nodes))].astype(np.int32)  # the edges into each node
    root_of = base + np.arange(len(first))
    score = np.full(n_nodes, -np.inf)
    score[root_of] = 0.0
    short = size <= LONG_PART
    part_of = which[at]
    depth = at - base[part_of].astype(np.int32) + length
    if short.all():
        by_depth = np.argsort(depth.astype(np.uint16), kind="stable")
    else:
        by_depth = np.flatnonzero(short[part_of])
        by_depth = by_depth[np.argsort(depth[by_depth].astype(np.uint16), kind="stable")]
    del at, length, part_of, which, left
    levels = np.r_[0, np.cumsum(np.bincount(depth[by_depth], minlength=2))[:-1], len(by_depth)]
    for lo, hi in zip(levels[:-1], levels[1:]):
        e = by_depth[lo:hi]
        if not len(e):
            continue
        value, t = score[source[e]] + weight[e], target[e]
        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        top = np.maximum.reduceat(value, head)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            score[t[head]] = safe + np.log(np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.r_[head, len(e)]))), head))
    for i in np.flatnonzero(~short):  # long parts: too narrow a lattice for whole levels at a time
        _filter_part(score, source, weight, into, int(root_of[i]), int(size[i]))
    with np.errstate(invalid="ignore"):
        share = np.nan_to_num(np.exp(score[source] + weight - score[target]), nan=0.0)
    # shares summed up inside each node, edge by edge, so that a node's ladder is the same in every batch
    ladder, degree = share.copy(), np.diff(into)
    nodes, j = np.flatnonzero(degree > 1), 1
    while len(nodes):
        e = into[nodes] + j
        ladder[e] += ladder[e - 1]
        j += 1
        nodes = nodes[degree[nodes] > j]
    ended = degree > 0
    ladder[into[1:][ended] - 1] = np.inf  # the last edge takes what rounding leaves
    # backward, all occurrences at once
    nonempty = np.flatnonzero(ends > starts)
    text = nonempty[np.searchsorted(starts[nonempty], begin, "right") - 1]
    ordinal = np.arange(len(begin)) - np.searchsorted(begin, starts[text])
    lane = np.argsort(part.astype(np.uint16) if len(first) < 65536 else part, kind="stable")  # near each other in memory
    with np.errstate(over="ignore"):
        state = mix(keys[text] + np.uint64(seed) * BASE + mix(ordinal.astype(np.uint64) + np.uint64(1)))[lane]
    root = root_of[part]
    node = (root + size[part])[lane]
    count = np.zeros(len(begin), np.int64)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    alone = {}
    if not short.all():
        own_long = ~short[part[lane]]
        for l, s in zip(lane[own_long].tolist(), state[own_long].tolist()):
            alone[l] = _draw_part(ladder, source, piece, into, int(root[l]), int(size[part[l]]), s)
            count[l] = len(alone[l])
        lane, state, node = lane[~own_long], state[~own_long], node[~own_long]
    while len(lane):
        u = (state >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        e = into[node]
        open_ = np.flatnonzero(ladder[e] <= u)
        while len(open_):
            e[open_] += 1
            open_ = open_[ladder[e[open_]] <= u[open_]]
        taken.append((lane, piece[e]))
        count[lane] += 1
        node = source[e]
        go = node > root[lane]
        lane, node = lane[go], node[go]
        with np.errstate(over="ignore"):
            state = mix(state[go] + BASE)
    offset = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for step, (l, p) in enumerate(taken):
        out[offset[l] + count[l] - 1 - step] = p
    for l, p in alone.items():
        out[offset[l] : offset[l] + count[l]] = p
    per = np.bincount(text, weights=count, minlength=len(starts)).astype(np.int64)
    return out, np.r_[0, np.cumsum(per)]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> bytes:
    size = v.size[ids]
    return v.blob[np.repeat(v.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()


def _chunks(b: pa.RecordBatch):
    """Slices of a batch of about CHUNK_BYTES of text."""
    size = np.array([0 if not x.is_valid else x.as_buffer().size for x in b.column(1)], np.int64)
    group = np.cumsum(size) // CHUNK_BYTES
    edge = np.r_[0, np.flatnonzero(np.diff(group)) + 1, b.num_rows]
    return [b.slice(i, j - i) for i, j in zip(edge[:-1], edge[1:]) if j > i]


def _encoded(v: Vocabulary, seed: int):
    def of(batches):
        for whole in batches:
            for b in _chunks(whole):
                data, starts, ends = text_bytes(b.column(1))
                keys = mix(np.asarray(b.column(0).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64))
                ids, offsets = sample(v, data, starts, ends, keys, seed)
                null = b.column(1).is_null()
                pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=null)
                back = [None if null[i].as_py() else hashlib.sha256(decode_ids(v, ids[x:y])).hexdigest() for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:]))]
                yield pa.RecordBatch.from_arrays([b.column(0), pieces, pa.array(np.diff(offsets)), pa.array(back, pa.string())], names=["doc_id", "pieces", "n_pieces", "decoded_sha256"])

    return of


def encode(docs: DataFrame, vocabulary: Vocabulary, seed: int = SEED) -> DataFrame:
    """doc_id, pieces, n_pieces and the SHA-256 of the decoded pieces of every row."""
    run = _encoded(vocabulary, seed)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, decoded_sha256 string")


def _decoded(v: Vocabulary):
    def of(batches):
        for b in batches:
            text = [None if not x.is_valid else decode_ids(v, np.asarray(x.values.to_numpy(), np.int64)).decode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return of


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of rows (doc_id, pieces)."""
    return encoded.select("doc_id", "pieces").mapInArrow(_decoded(vocabulary), "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), Vocabulary.load())
