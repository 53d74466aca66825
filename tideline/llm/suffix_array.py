"""Suffix-array dedup over bytes: deep-shallow sorting in each shard.

The suffixes that begin a 50-byte string are put into buckets by their passage's anchor.
Multikey quicksort over 8-byte characters (a three-way partition of every open group
around a pivot of its own, all groups of a shard in the same step) sorts them to a shallow
depth. Groups that share their prefix to that depth go through blind tries if they are
small; larger ones are partitioned on until they are small or reach the full depth. A blind
trie keeps its strings in order with the depths at which neighbours part; an insertion walks down
by the branching bytes alone, compares once with the string it reaches, and goes in where the two
part. Neighbours that agree to the full depth form a group, and the smallest document in it is
the first that holds the string.
See :mod:`repeats` for how documents, passages and shards meet.

Defined cases: a null text is empty; texts under ``k`` bytes keep everything; a null doc_id
takes no part; rows that repeat a doc_id don't count as earlier than each other; extra
columns are left out; long texts are cut into blocks' steps, never into prefixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .repeats import Block, Intervals, Plan, covered_runs, remove_repeats

BYTES = Plan(k=50, m=28, by_word=False)
SHALLOW, BLIND = 16, 32  # bytes; strings in a blind trie
_8 = np.uint64(8)


class Characters:
    """8-byte characters of a text that sort like its bytes."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.r_[data, np.zeros(8, np.uint8)]
        self.eight = np.ndarray((len(data) + 1,), ">u8", self.bytes, strides=(1,))

    def at(self, place: np.ndarray, left: np.ndarray | int = 8) -> np.ndarray:
        """The characters at ``place``, of which only the first ``left`` bytes count."""
        got = self.eight[place].astype(np.uint64)
        drop = (8 - np.clip(left, 0, 8)).astype(np.uint64) * _8 if isinstance(left, np.ndarray) else np.uint64(8 * (8 - min(left, 8)))
        return (got >> drop) << drop


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start .. start + size of every group, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def multikey_quicksort(text: Characters, order: np.ndarray, start: np.ndarray, size: np.ndarray, at: int, to: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the groups (start, size) of ``order`` in place from byte ``at`` on, until a group has ``stop`` strings or fewer or agrees to byte ``to``.

    Returns the groups that it leaves with more than one string: start, size and the byte to which they agree.
    """
    depth = np.full(len(start), at)
    left = []
    while len(start):
        open_ = (size > stop) & (depth < to)
        left.append((start[~open_], size[~open_], depth[~open_]))
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            break
        where = _spread(start, size)
        group = np.repeat(np.arange(len(start)), size)
        row = order[where]
        key = text.at(row + depth[group], (to - depth)[group])
        base = np.cumsum(size) - size
        a, b, c = key[base], key[base + size // 2], key[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]  # the median of three
        less, equal = key < pivot, key == pivot
        n_less, n_equal = np.cumsum(less), np.cumsum(equal)
        last = base + size - 1
        before_less, before_equal = (n_less[base] - less[base]), (n_equal[base] - equal[base])
        less_in, equal_in = n_less[last] - before_less, n_equal[last] - before_equal
        rank_less, rank_equal = n_less - before_less[group], n_equal - before_equal[group]
        nth = np.arange(len(where)) - base[group] + 1
        to_place = np.where(less, rank_less, np.where(equal, less_in[group] + rank_equal, less_in[group] + equal_in[group] + nth - rank_less - rank_equal)) - 1
        order[start[group] + to_place] = row
        more_in = size - less_in - equal_in
        start = np.r_[start, start + less_in, start + less_in + equal_in]
        size = np.r_[less_in, equal_in, more_in]
        depth = np.r_[depth, np.minimum(depth + 8, to), depth]
        many = size > 1
        start, size, depth = start[many], size[many], depth[many]
    if not left:
        return start, size, depth
    start, size, depth = (np.concatenate(x) for x in zip(*left))
    return start, size, depth


def _agree(text: Characters, a: np.ndarray, b: np.ndarray, at: int, to: int) -> np.ndarray:
    """The byte at which strings ``a`` and ``b`` part, ``to`` if they agree so far; they do to byte ``at``."""
    out = np.full(len(a), to)
    live = np.arange(len(a))
    for d in range(at, to, 8):
        differ = text.at(a[live] + d, to - d) ^ text.at(b[live] + d, to - d)
        apart = differ != 0
        first = sum((differ[apart] < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))  # bytes that agree
        out[live[apart]] = d + first
        live = live[~apart]
        if not len(live):
            break
    return out


def blind_tries(text: Characters, strings: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts every row of ``strings`` (places in the text that agree to byte ``at``; -1 behind a row's last one).

    Returns the rows in order and, for each string but a row's first, the byte at which it parts from the one before it. All
    rows' tries take their r-th string in the same step.
    """
    n, width = strings.shape
    leaf, part = strings[:, :1].repeat(width, axis=1), np.full((n, width), to)
    for r in range(1, width):
        rows = np.flatnonzero(strings[:, r] >= 0)
        if not len(rows):
            break
        x = strings[rows, r]
        # down: at each branch to the last child whose byte is not above the string's own
        best, barred = np.zeros(len(rows), np.int64), np.full(len(rows), to)
        for i in range(1, r):
            d = part[rows, i]
            test = np.flatnonzero((d < to) & (d <= barred))
            dt = d[test]
            passes = text.bytes[x[test] + dt] >= text.bytes[leaf[rows[test], i] + dt]
            best[test[passes]], barred[test[passes]] = i, to
            barred[test[~passes]] = dt[~passes]
            same = np.flatnonzero((d >= to) & (best == i - 1))  # an equal string behind the best one
            best[same] = i
        other = leaf[rows, best]
        lcp = _agree(text, x, other, at, to)
        cap = np.minimum(lcp, to - 1)
        above = (lcp >= to) | (text.bytes[x + cap] > text.bytes[other + cap])
        # the strings that agree with the one reached beyond that byte stand together: in front of them or behind them
        inside = part[rows, :r] > lcp[:, None]
        column = np.arange(r)
        breaks = np.where(~inside & (column[None, :] <= best[:, None]), column[None, :], 0)
        front = breaks.max(axis=1)
        behind = np.where(~inside & (column[None, :] > best[:, None]), column[None, :], r).min(axis=1)
        place = np.where(lcp >= to, best + 1, np.where(above, behind, front))
        shift = np.arange(1, r + 1)[None, :] > place[:, None]
        new_leaf, new_part = leaf[rows, : r + 1], part[rows, : r + 1]
        new_leaf[:, 1:] = np.where(shift, leaf[rows, :r], new_leaf[:, 1:])
        new_part[:, 1:] = np.where(shift, part[rows, :r], new_part[:, 1:])
        line = np.arange(len(rows))
        new_leaf[line, place] = x
        # in front of others the string takes over their parting from what stands before, and they part from it at lcp
        lower = ~above
        new_part[line[~lower], place[~lower]] = lcp[~lower]
        if lower.any():
            new_part[line[lower], place[lower]] = np.where(place[lower] > 0, part[rows[lower], np.minimum(place[lower], r - 1)], to)
            new_part[line[lower], place[lower] + 1] = lcp[lower]
        leaf[rows, : r + 1], part[rows, : r + 1] = new_leaf, new_part
    return leaf, part


def deep_shallow(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, depth: int, shallow: int = SHALLOW, blind: int = BLIND) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` by bucket (ascending) and then their first ``depth`` bytes, as places in ``at``,
    and the first row of each group of equals."""
    text = Characters(data)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = at.copy()
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[start, n])
    many = size > 1
    tied = np.zeros(n, bool)  # a suffix that equals the one before it
    start, size, reached = multikey_quicksort(text, order, start[many], size[many], 0, min(shallow, depth), 1)
    large = size > blind
    rest = [(start[~large], size[~large], reached[~large])]
    if large.any():
        rest.append(multikey_quicksort(text, order, start[large], size[large], shallow, depth, blind))
    start, size, reached = (np.concatenate(x) for x in zip(*rest))
    equal = reached >= depth
    at_equal = _spread(start[equal], size[equal])
    tied[at_equal] = True
    tied[start[equal]] = False
    start, size = start[~equal], size[~equal]
    width = 2
    while len(start):
        own = size <= width
        s, m = start[own], size[own]
        for i in range(0, len(s), 1 << 16):
            s1, m1 = s[i : i + (1 << 16)], m[i : i + (1 << 16)]
            column = np.arange(width)[None, :]
            real = column < m1[:, None]
            place = np.where(real, s1[:, None] + column, 0)
            leaf, part = blind_tries(text, np.where(real, order[place], -1), min(shallow, depth), depth)
            order[place[real]] = leaf[real]
            tied[place[real]] = (part >= depth)[real]
            tied[s1] = False
        start, size, width = start[~own], size[~own], width * 2
    return order, np.flatnonzero(~tied)


def solve(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, group: np.ndarray, plan: Plan) -> Intervals:
    """What each passage's owner loses to earlier documents, by groups of the suffix array."""
    windows = ends - starts - plan.k + 1
    offsets = np.cumsum(windows) - windows
    which = np.repeat(np.arange(len(starts)), windows)
    start = np.arange(windows.sum()) - offsets[which]
    at = starts[which] + start
    order, head = deep_shallow(data, at, group[which], plan.k)
    place = np.empty(len(data), np.int64)
    place[at] = np.arange(len(at))
    rows = place[order]
    low = np.minimum.reduceat(owner[which[rows]], head)
    first = np.empty(len(at), np.int64)
    first[rows] = np.repeat(low, np.diff(np.r_[head, len(at)]))
    return covered_runs(first < owner[which], which, start, plan.k)


def finish(block: Block, gone: np.ndarray) -> list:
    sums = np.r_[0, np.cumsum(gone)]
    lead = gone.copy()
    if len(gone):
        lead[1:] &= ~gone[:-1]
        edge = block.starts[block.starts < len(gone)]
        lead[edge] |= gone[edge]
    spans = np.r_[0, np.cumsum(lead)]
    digests = [hashlib.sha256(block.bytes[s:e][~gone[s:e]].tobytes()).hexdigest() for s, e in zip(block.starts, block.ends)]
    return [block.ends - block.starts, sums[block.ends] - sums[block.starts], spans[block.ends] - spans[block.starts], digests]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup_bytes(docs: DataFrame, plan: Plan = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return remove_repeats(docs, plan, solve, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", SCHEMA)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))


#: Every byte is two digits of the text's hexadecimal form; a 50-byte string is 100 digits at an odd place.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
x AS (SELECT doc_id, t, unnest(range(0, len(t) // 2 - 49)) AS i FROM d WHERE len(t) >= 100),
h AS (SELECT doc_id, i, md5_number(substr(t, 2 * i + 1, 100)) AS h FROM x),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS late FROM h),
s AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS lead FROM f WHERE late),
r AS (SELECT doc_id, i, sum(lead::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
p AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(t), 2 * max(b) + 1) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (len(t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, t))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""
