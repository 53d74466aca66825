"""Repeated windows across documents: the frame that substring and suffix-array dedup share.

A window is ``k`` successive units (words or bytes) of one document. Its anchor is the
smallest hash of the ``m`` units long grams in it, so equal windows have equal anchors.

1. Documents are packed into blocks of a bounded size in the order in which they are read, one
   row a block, and written once as a table that is bucketed by block; later steps meet a
   block's documents there without a shuffle of text.
2. Each block puts forward its distinct anchors with the number of its documents that hold
   them; anchors of one document only drop out.
3. Successive windows with the same anchor make a passage. Each block puts forward its distinct
   passages; their anchors say in which shard they meet. Anchors with more than ``hot``
   documents don't: each of their windows becomes a passage of its own and goes where its
   own hash says, so a common phrase in many contexts spreads over all shards.
4. In a shard, passages with equal bytes become one, owned by the smallest document that holds it.
   Any later document loses the whole passage. What the owner itself loses to still
   earlier documents, that hold a part of the passage in other surroundings, is the
   method's own work: ``solve`` returns it as intervals. Only anchors with two different
   passages need it.
5. The answers go back to their blocks and mark the units that go.

A block's rows count once for a passage, whatever the number of its copies, so a text
that a third of all documents hold costs a short row per block. Shards are streamed
bucket by bucket, sorted (and spilled) by Spark; memory holds one bucket, whose
size is bounded by the number of buckets, which grows with the bytes of text.

Hashes only bring candidates together: passages are equal if their bytes are.

Very long texts: a document is never split; a block holds at least one document, and its windows are
hashed in steps of ``STEP``, so memory is a small multiple of the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, mix, partitions, slice_hashes, stored, text_bytes, window_hashes, words

BLOCK_BYTES, PARTITION_BYTES, BUCKETS_PER_PARTITION = 2 << 20, 64 << 20, 8
HOT, STEP = 2000, 1 << 20
NOBODY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Plan:
    k: int
    m: int
    by_word: bool
    hot: int = HOT
    block_bytes: int = BLOCK_BYTES

    @property
    def span(self) -> int:
        """Grams in a window, and the most windows in a passage."""
        return self.k - self.m + 1


_ZSTD = pa.Codec("zstd", 1)


def squeezed(x: np.ndarray | bytes) -> bytes:
    """An array compressed, behind its length in bytes."""
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def loosened(x: bytes) -> bytes:
    return _ZSTD.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True)


def _loosened(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(loosened(x), kind) for x in table.column(name).to_pylist()]


def _together(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


# 1. blocks

_BLOCK = "block long, ids binary, known binary, ends binary, text binary"


def _packed(block_bytes: int):
    """Rows (doc_id, text) as blocks: the doc_ids, which of them are not null, where each text ends, the texts."""

    def of(batches):
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            data, starts, ends = text_bytes(b.column(1))
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy()
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block_bytes, "right")))
                row = [ids[lo:hi].tobytes(), known[lo:hi].tobytes(), (ends[lo:hi] - starts[lo]).tobytes(), squeezed(data[starts[lo] : ends[hi - 1]])]
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["block", "ids", "known", "ends", "text"])
                made, lo = made + 1, hi

    return of


class Block:
    """A block's texts as units: ``unit`` values; ``starts`` and ``ends`` of the documents among them."""

    def __init__(self, row: dict, by_word: bool):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        ends = np.frombuffer(row["ends"], np.int64)
        starts = np.r_[0, ends[:-1]]
        data = np.frombuffer(loosened(row["text"]), np.uint8)
        if by_word:
            begin, end, n = words(data, starts, ends)
            self.unit = slice_hashes(data, begin, end)
            size = end - begin
            self.end = np.cumsum(size + 1)
            self.begin = self.end - size - 1
            # the words, each with one blank behind it
            self.bytes = np.full(int((size + 1).sum()), 32, np.uint8)
            inside = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.bytes[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[inside]
            self.ends = np.cumsum(n)
            self.starts = self.ends - n
        else:
            self.bytes, self.unit, self.starts, self.ends = data, data, starts, ends
            self.begin = self.end = None
        self.owner = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)

    def cut(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``bytes`` the units first .. first + n begin and end."""
        return (first, first + n) if self.begin is None else (self.begin[first], self.end[first + n - 1])


# 2. anchors


def _minima(g: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` successive values."""
    n = len(g) - span + 1
    size = 1
    while size * 2 <= span:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[:n], g[span - size : span - size + n])


def _runs(block: Block, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of successive windows of one document with the same anchor, at most ``span`` long:
    (first window, windows, anchor), step by step."""
    n = len(block.unit) - plan.k + 1
    for lo in range(0, max(n, 0), STEP):
        hi = min(lo + STEP, n)
        anchor = _minima(window_hashes(block.unit[lo : hi + plan.k - 1], plan.m), plan.span)
        own = block.owner[lo:hi]
        whole = own == block.owner[lo + plan.k - 1 : hi + plan.k - 1]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(anchor)])
        good = whole[first] & block.known[own[first]]
        first, size = first[good], size[good]
        parts = -(-size // plan.span)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.repeat(size, parts) - nth * plan.span
            first, size = np.repeat(first, parts) + nth * plan.span, np.minimum(left, plan.span)
        yield lo + first, size, anchor[first]


_ANCHORS = "bucket int, block long, h binary, n binary"


def _anchors(plan: Plan, n_buckets: int):
    """Per block and bucket: the upper halves of its anchors' hashes and the number of documents with each."""

    def of(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, plan.by_word)
                h, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for first, _, anchor in _runs(block, plan):
                    h.append(anchor), doc.append(block.ids[block.owner[first]])
                h, doc = np.concatenate(h), np.concatenate(doc)
                if not len(h):
                    continue
                key = _anchor_key(h, n_buckets)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.r_[True, key[1:] != key[:-1]]
                other = new | np.r_[True, doc[1:] != doc[:-1]]
                head = np.flatnonzero(new)
                n = np.minimum(np.add.reduceat(other.astype(np.int64), head), 65535).astype(np.uint16)
                key = key[head]
                bucket = (key >> np.uint64(32)).astype(np.int64)
                edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(key)]
                low = key.astype(np.uint32)
                cols = [bucket[edge[:-1]].astype(np.int32), np.full(len(edge) - 1, row["block"])]
                cut = [pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary()) for x in (low, n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *cut], names=["bucket", "block", "h", "n"])

    return of


def _anchor_key(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """An anchor's bucket and the upper half of its hash, in one number. Anchors that share it only meet needlessly."""
    return ((h % np.uint64(n_buckets)) << np.uint64(32)) | (h >> np.uint64(32))


def _by_bucket(batches) -> Iterator[pa.Table]:
    """The rows of each bucket, from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column(0).to_numpy()
        edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if held and held[0].column(0)[0].as_py() != bucket[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """The arrays in a binary column, end to end."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _lengths(table: pa.Table, name: str, width: int) -> np.ndarray:
    """How many values of ``width`` bytes each row's array holds."""
    _, starts, ends = text_bytes(table.column(name))
    return (ends - starts) // width


_SHARED = "block long, cold binary, hot binary"


def _shared(hot: int):
    """Per block: the keys of its anchors that other documents hold too, the hot ones apart."""

    def of(batches):
        for t in _by_bucket(batches):
            h, n = _joined(t, "h", np.uint32), _joined(t, "n", np.uint16)
            row = np.repeat(np.arange(t.num_rows), _lengths(t, "h", 4))
            order = np.argsort(h, kind="stable")
            h, n, row = h[order], n[order], row[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            total = np.repeat(np.add.reduceat(n.astype(np.int64), head), np.diff(np.r_[head, len(h)]))
            key = (np.uint64(t.column(0)[0].as_py()) << np.uint64(32)) | h.astype(np.uint64)
            by_row = np.argsort(row, kind="stable")
            key, total, row = key[by_row], total[by_row], row[by_row]
            kind = {"cold": (total > 1) & (total <= hot), "hot": total > hot}
            cut = {}
            for name, mask in kind.items():
                own, at = key[mask], np.searchsorted(row[mask], np.arange(t.num_rows + 1))
                cut[name] = pa.array([own[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
            out = pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), cut["cold"], cut["hot"]], names=["block", "cold", "hot"])
            some = np.bincount(row[total > 1], minlength=t.num_rows) > 0
            yield out.filter(pa.array(some))

    return of


# 3. passages


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _hash_slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """slice_hashes for slices in any order; those that begin later also end later."""
    order = np.argsort(begin, kind="stable")
    out = np.empty(len(begin), np.uint64)
    out[order] = slice_hashes(data, begin[order], end[order])
    return out


def _found(block: Block, shared: pa.Table, plan: Plan, n_buckets: int):
    """The block's passages: (first window, windows, route, hash of the bytes) of every occurrence."""
    cold, hot = (np.sort(_joined(shared, x, np.uint64)) for x in ("cold", "hot"))
    out = []
    for first, size, anchor in _runs(block, plan):
        key = _anchor_key(anchor, n_buckets)
        held, common = _in(cold, key), _in(hot, key)
        f, n, route = first[held], size[held], anchor[held]
        if common.any():  # every window for itself
            n1 = size[common]
            f1 = np.repeat(first[common] - (np.cumsum(n1) - n1), n1) + np.arange(n1.sum())
            own = _hash_slices(block.bytes, *block.cut(f1, np.full(len(f1), plan.k)))
            f, n, route = np.r_[f, f1], np.r_[n, np.ones(len(f1), np.int64)], np.r_[route, own]
        if len(f):
            out.append((f, n, route, _hash_slices(block.bytes, *block.cut(f, n + plan.k - 1))))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _equal_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], for each pair; eight bytes at a time."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    same, live = np.ones(len(a), bool), np.arange(len(a))
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        drop = ((8 - left) * 8).astype(np.uint64)  # low bytes come first
        differ = (eight[a[live] + at] ^ eight[b[live] + at]) << drop
        same[live[differ != 0]] = False
        at += 8
        live = live[(differ == 0) & (size[live] > at)]
    return same


_PASSAGES = "bucket int, block long, kind int, start long, a binary, b binary, text binary"
_NAMES = ["bucket", "block", "kind", "start", "a", "b", "text"]
PLACES, ASKED = 0, 1


def _passages(plan: Plan, n_buckets: int):
    """Rows of two kinds. ASKED, per bucket: the number of the first of the block's distinct passages there (they are numbered by bucket), their
    routes (the hash's upper half), byte lengths and the smallest and largest document of the block that hold each, and their bytes. PLACES, one row: first
    window, number of windows and passage of every occurrence, which only travel along."""

    def of(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out = []
        for row in docs.to_pylist() if shared.num_rows else []:
            block = Block(row, plan.by_word)
            found = _found(block, shared, plan, n_buckets)
            if found is None:
                continue
            first, n, route, fh = found
            doc = block.ids[block.owner[first]]
            bucket = (route % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((fh, route, bucket))
            first, n, route, fh, doc, bucket = (x[order] for x in (first, n, route, fh, doc, bucket))
            a, b = block.cut(first, n + plan.k - 1)
            same = np.r_[False, (route[1:] == route[:-1]) & (fh[1:] == fh[:-1]) & (n[1:] == n[:-1]) & (b[1:] - a[1:] == b[:-1] - a[:-1])]
            pair = np.flatnonzero(same)
            same[pair] = _equal_slices(block.bytes, a[pair], a[pair - 1], (b - a)[pair])
            head = np.flatnonzero(~same)
            number = np.cumsum(~same) - 1
            by_place = np.argsort(first)
            step = np.diff(first[by_place], prepend=0)
            places = squeezed(np.concatenate([step, n[by_place], number[by_place]]).astype(np.uint32))
            out.append((int(row["block"]) % n_buckets, row["block"], PLACES, 0, places, b"", b""))
            lo, hi = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            a, b, half, bucket = a[head], b[head], (route[head] >> np.uint64(32)).astype(np.uint32), bucket[head]
            text = block.bytes.tobytes()
            edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(head)]
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                joined = b"".join([text[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist())])
                about = squeezed(np.concatenate([b[i:j] - a[i:j], lo[i:j], hi[i:j] - lo[i:j]]))
                out.append((int(bucket[i]), row["block"], ASKED, i, half[i:j].tobytes(), about, squeezed(joined)))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=_NAMES)

    return of


# 4. shards

Intervals = tuple[np.ndarray, np.ndarray, np.ndarray]
_ANSWERS = "block long, kind int, a binary, b binary, c binary"


def _answers(plan: Plan, solve: Callable[..., Intervals]):
    """PLACES as they come. Per row of questions: the passages that lose something and the number of their intervals, the first
    owner of each, and the starts and lengths (in units) of the intervals which that owner loses."""

    def of(batches):
        for t in _by_bucket(batches):
            places = t.filter(pa.array(t.column("kind").to_numpy() == PLACES)).select(["block", "kind", "a"])
            empty = pa.array([b""] * places.num_rows, pa.binary())
            yield from places.append_column("b", empty).append_column("c", empty).combine_chunks().to_batches()
            asked = t.filter(pa.array(t.column("kind").to_numpy() == ASKED)).combine_chunks()
            if asked.num_rows:
                yield _shard(asked, plan, solve)

    return of


def _shard(asked: pa.Table, plan: Plan, solve: Callable) -> pa.RecordBatch:
    many_in = _lengths(asked, "a", 4)
    row = np.repeat(np.arange(asked.num_rows), many_in)
    route = _joined(asked, "a", np.uint32)
    number = asked.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(many_in) - many_in, many_in)
    about = [x.reshape(3, -1) for x in _loosened(asked, "b", np.int64)]
    size, lo, more = (np.concatenate([x[i] for x in about]) for i in range(3))
    hi = lo + more
    offsets = pa.py_buffer(np.r_[0, np.cumsum(size)])
    text = pa.py_buffer(b"".join(loosened(x) for x in asked.column("text").to_pylist()))
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, offsets, text]).dictionary_encode()
    code = coded.indices.to_numpy()
    n = len(coded.dictionary)
    order = np.argsort(code, kind="stable")
    head = np.searchsorted(code[order], np.arange(n))
    owner = np.minimum.reduceat(lo[order], head)
    _, group, many = np.unique(route[order[head]], return_inverse=True, return_counts=True)
    which = np.flatnonzero(many[group] > 1)  # passages whose anchor has other passages too
    which = which[np.argsort(group[which], kind="stable")]
    if len(which):
        data, starts, ends = text_bytes(coded.dictionary.take(pa.array(which)))
        at, begin, length = solve(data, starts, ends, owner[which], group[which], plan)
        by = np.lexsort((begin, which[at]))
        at, begin, length = which[at][by], begin[by], length[by]
    else:
        at = begin = length = np.zeros(0, np.int64)
    count = np.bincount(at, minlength=n)
    from_ = np.cumsum(count) - count
    useful = (hi > owner[code]) | ((lo == owner[code]) & (count[code] > 0))
    code, row, number = code[useful], row[useful], number[useful]
    cut = np.searchsorted(row, np.arange(asked.num_rows + 1))
    out = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        c = code[i:j]
        m = count[c]
        own = np.repeat(from_[c] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        out.append((squeezed(np.concatenate([number[i:j], m]).astype(np.uint32)), squeezed(owner[c]), squeezed(np.concatenate([begin[own], length[own]]).astype(np.uint16))))
    kind = pa.array(np.full(asked.num_rows, ASKED, np.int32))
    return pa.RecordBatch.from_arrays([asked.column("block").combine_chunks(), kind, *(pa.array(c, pa.binary()) for c in zip(*out))], names=["block", "kind", *"abc"])


def covered_runs(late: np.ndarray, which: np.ndarray, start: np.ndarray, k: int) -> Intervals:
    """Runs of late windows as (passage, first unit, units); windows are in order of passage and start."""
    at = np.flatnonzero(late)
    if not len(at):
        return at, at, at
    new = np.r_[True, (which[at[1:]] != which[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(at)] - 1
    return which[at[head]], start[at[head]], start[at[last]] - start[at[head]] + k


# 5. back in the blocks


def _gone(block: Block, back: pa.Table, k: int) -> np.ndarray:
    """A flag per unit of the block: whether it goes."""
    change = np.zeros(len(block.unit) + 1, np.int64)
    kind = back.column("kind").to_numpy()
    places, answers = back.filter(pa.array(kind == PLACES)), back.filter(pa.array(kind == ASKED))
    if places.num_rows:
        step, n, number = _together(_loosened(places, "a", np.uint32), np.uint32).reshape(3, -1).astype(np.int64)
        first = np.cumsum(step)
        pairs = [x.reshape(2, -1) for x in _loosened(answers, "a", np.uint32)]
        asked, count = (_together([x[i] for x in pairs], np.uint32).astype(np.int64) for i in range(2))
        owner = _together(_loosened(answers, "b", np.int64), np.int64)
        pairs = [x.reshape(2, -1) for x in _loosened(answers, "c", np.uint16)]
        begin, length = (_together([x[i] for x in pairs], np.uint16).astype(np.int64) for i in range(2))
        size = int(number.max()) + 1
        owner_of, count_of, from_of = np.full(size, NOBODY), np.zeros(size, np.int64), np.zeros(size, np.int64)
        owner_of[asked], count_of[asked], from_of[asked] = owner, count, np.cumsum(count) - count
        doc = block.ids[block.owner[first]]
        later = doc > owner_of[number]
        np.add.at(change, first[later], 1)
        np.add.at(change, first[later] + n[later] + k - 1, -1)
        own = np.flatnonzero((doc == owner_of[number]) & (count_of[number] > 0))
        m = count_of[number[own]]
        at = np.repeat(from_of[number[own]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        start = np.repeat(first[own], m) + begin[at]
        np.add.at(change, start, 1)
        np.add.at(change, start + length[at], -1)
    return np.cumsum(change[:-1]) > 0


def _finished(plan: Plan, finish: Callable, schema: pa.Schema):
    """finish(block, gone: a flag per unit) -> columns beside doc_id."""

    def of(docs: pa.Table, back: pa.Table) -> pa.Table:
        tables = []
        for row in docs.to_pylist():
            block = Block(row, plan.by_word)
            columns = finish(block, _gone(block, back, plan.k))
            ids = pa.array(block.ids, mask=~block.known)
            tables.append(pa.Table.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return of


def remove_repeats(docs: DataFrame, plan: Plan, solve: Callable, finish: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """A row per row of ``docs``: doc_id and what ``finish`` makes of the units that go."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0  # one row
    n = max(partitions(spark), math.ceil(size / PARTITION_BYTES))
    n_buckets = n * BUCKETS_PER_PARTITION
    blocks = bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packed(plan.block_bytes), _BLOCK), "block", n)
    dealt = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    shared = stored(dealt(blocks.mapInArrow(_anchors(plan, n_buckets), _ANCHORS)).mapInArrow(_shared(plan.hot), _SHARED))
    with_block = lambda df, run, to: blocks.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(run, to)
    answers = dealt(with_block(shared, _passages(plan, n_buckets), _PASSAGES)).mapInArrow(_answers(plan, solve), _ANSWERS)
    return with_block(answers, _finished(plan, finish, arrow), schema)
