"""Substring dedup over words: a compressed FM-index per shard and backward search.

A shard indexes the passages of its range of content as sequences of word numbers, each with the
first document that holds it. The owners' passages are then streamed through the index from their last word to their first:
matching statistics against the passages of earlier documents, with a step to the parent interval at every
mismatch, report the stretches of at least ``k`` words that an earlier document holds too.
See :mod:`repeats` for how documents, passages and shards meet, and :mod:`fm_index` for the search.

Defined cases: a null or blank text has no words and keeps the empty text; a null doc_id takes
no part; rows that repeat a doc_id don't count as earlier than each other; extra columns
are left out; long texts are handled in steps, never as prefixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .fm_index import FMIndex, matches
from .repeats import Block, Intervals, Plan, remove_repeats

WORDS = Plan(k=13, m=8, by_word=True)
LANES = 1 << 16


def solve(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, group: np.ndarray, plan: Plan) -> Intervals:
    """What each passage's owner loses to earlier documents. Every word of a passage has one blank behind it."""
    stop = np.flatnonzero(data == 32) + 1
    offsets = pa.py_buffer(np.r_[0, stop].astype(np.int64))
    word = pa.Array.from_buffers(pa.large_binary(), len(stop), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    n = np.searchsorted(stop, ends, "right") - np.searchsorted(stop, starts, "right")
    text = np.zeros(len(stop) + len(n), np.int64)
    text[np.arange(len(stop)) + np.repeat(np.arange(len(n)), n)] = word.indices.to_numpy() + 1
    first = np.cumsum(n + 1) - n - 1
    index = FMIndex(text, len(word.dictionary) + 1, np.repeat(owner, n + 1), int(n.max()) + 1)
    found = [matches(index, text, first[i : i + LANES], n[i : i + LANES], owner[i : i + LANES], plan.k) for i in range(0, len(n), LANES)]
    return tuple(np.concatenate([x + i * LANES if part == 0 else x for i, x in enumerate(xs)]) for part, xs in enumerate(zip(*found)))


def finish(block: Block, gone: np.ndarray) -> list:
    sums = np.r_[0, np.cumsum(gone)]
    keep = np.repeat(~gone, block.end - block.begin) if len(gone) else np.zeros(0, bool)
    digests = []
    for s, e in zip(block.starts, block.ends):
        a, b = (block.begin[s], block.end[e - 1]) if e > s else (0, 0)
        digests.append(hashlib.sha256(block.bytes[a:b][keep[a:b]].tobytes()[:-1]).hexdigest())
    return [block.ends - block.starts, sums[block.ends] - sums[block.starts], digests]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup_words(docs: DataFrame, plan: Plan = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return remove_repeats(docs, plan, solve, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", SCHEMA)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM x),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS late FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE late),
w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(w, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS kept
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
