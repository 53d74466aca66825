"""Line dedup by range-partitioned hashes.

Lines become (hash, doc_id, position) rows, range-partitioned by hash and then
document, with documents in descending order inside a hash, so that a line which
half of all documents hold is still dealt evenly over tasks. Each task streams its
sorted rows: the first document of a run of equal hashes keeps its lines, all later
ones lose theirs. Only the runs at the two edges of a task can go on in another; their
heads (two rows a task at most) are put together on the driver. What comes out is a
compressed bitmap of kept lines for each document that loses any, never text; the query and the pipeline's stage
apply the bitmaps to the texts.

Defined cases: a null or empty text is one empty line; lines with keys under
``min_chars`` code points stay; a null doc_id takes no part and keeps all its lines; rows
that repeat a doc_id count as one document; extra columns are left out by :func:`keep_bitmaps` and kept by
:func:`drop_lines`. A long text is split into lines by one task; its lines are dealt like all others.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, documents, partitions, shared_dir

MIN_CHARS, MIN_DOCS = 20, 3
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE_BYTES).lower()


def _keyed(min_chars: int):
    def of(batches):
        for b in batches:
            h, docs, at = [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or d is None:
                    continue
                for i, line in enumerate(text.encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        h.append(xxhash.xxh3_128_digest(key))
                        docs.append(d)
                        at.append(i)
            if h:
                pair = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(at, pa.int32())], schema=_LINES)

    return of


def _runs(table: pa.Table):
    """Arrays of a table of lines, the first row of each run of equal hashes, and the documents in each run."""
    h1, h2, doc, pos = (table.column(i).to_numpy() for i in range(4))
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    start = np.flatnonzero(new)
    n_docs = np.add.reduceat((new | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64), start)
    return h1, h2, doc, pos, start, n_docs


def _complete(batches):
    """Tables that end where a run ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        if held and (held[-1].column(0)[-1] != b.column(0)[0] or held[-1].column(1)[-1] != b.column(1)[0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("keeper", pa.int64()), ("n", pa.int64())])


def _edges(batches):
    first = last = None
    for t in _complete(batches):
        h1, h2, doc, _, start, n = _runs(t)
        head = lambda i: (int(h1[start[i]]), int(h2[start[i]]), int(doc[start[i]]), int(n[i]))  # noqa: B023, E731
        first, last = first or head(0), head(len(start) - 1)
    rows = [x for x in dict.fromkeys([first, last]) if x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_EDGES)


_DROPS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32())])


def _losers(edges: dict[tuple[int, int], tuple[int, int]], min_docs: int):
    """edges: the largest document and the number of documents of each hash at a task's edge."""
    known = np.array(sorted(h for h, _ in edges), np.int64)

    def of(batches):
        for t in _complete(batches):
            h1, h2, doc, pos, start, n = _runs(t)
            keeper = doc[start].copy()
            if len(known):
                for i in np.flatnonzero(np.isin(h1[start], known)):
                    if found := edges.get((int(h1[start[i]]), int(h2[start[i]]))):
                        keeper[i], n[i] = found
            size = np.diff(np.r_[start, len(doc)])
            lost = np.repeat(n >= min_docs, size) & (doc != np.repeat(keeper, size))
            if lost.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[lost]), pa.array(pos[lost])], schema=_DROPS)

    return of


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    """Line positions as a compressed bitmap, 1 for a kept line; it ends with the last dropped one, all lines behind it are kept."""

    def one(at):
        bits = np.ones(-(-(int(max(at)) + 1) // 8) * 8, np.uint8)  # whole bytes, the rest kept
        bits[np.asarray(at, np.int64)] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return dropped.map(one)


def dropped_at(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The positions below ``n_lines`` that a bitmap drops."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
    return np.flatnonzero(bits == 0)


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, keep_bitmap) of documents that lose lines, one row each."""
    spark = docs.sparkSession
    shared_dir(spark)
    lines = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_keyed(min_chars), "h1 long, h2 long, doc_id long, pos int")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    ranged = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "pos").checkpoint()
    heads: dict[tuple[int, int], list[int]] = {}
    for r in ranged.mapInArrow(_edges, "h1 long, h2 long, keeper long, n long").collect():  # two rows a task at most
        old = heads.setdefault((r.h1, r.h2), [r.keeper, 0])
        heads[r.h1, r.h2] = [max(old[0], r.keeper), old[1] + r.n]
    lost = ranged.mapInArrow(_losers({k: (v[0], v[1]) for k, v in heads.items()}, min_docs), "doc_id long, pos int")
    return lost.groupBy("doc_id").agg(F.collect_set("pos").alias("dropped")).select("doc_id", _bitmap("dropped").alias("keep_bitmap"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines and keep_bitmap of every row (zlib over packed bits, 1 for a kept line, as far as the last dropped
    one; null where all lines stay)."""
    counted = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return counted.join(line_bitmaps(docs, min_chars, min_docs), "doc_id", "left")


def _cut(digest: bool, column: str = "keep_bitmap"):
    """Applies the bitmaps in ``column`` to texts, batch by batch."""

    def of(batches):
        for b in batches:
            text = ["" if t is None else t for t in b.column("text").to_pylist()]
            kept, n, lost = [], [], []
            for t, bitmap in zip(text, b.column(column).to_pylist()):
                lines = t.split("\n")
                gone = set(dropped_at(bitmap, len(lines)).tolist()) if bitmap else ()
                n.append(len(lines))
                lost.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
            if digest:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept])], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.string())], names=[*b.schema.names[:-1], "_tl_kept"])

    return of


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its columns and with repeated lines cut from ``text``; a document may end up empty."""
    lost = line_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "_tl_id", "keep_bitmap": "_tl_keep_bitmap"})
    touched = docs.join(lost, docs["doc_id"].cast("long") == lost["_tl_id"], "left").drop("_tl_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = touched.mapInArrow(_cut(False, "_tl_keep_bitmap"), f"{schema}, _tl_kept string")
    text = F.when(F.col("text").isNotNull(), F.col("_tl_kept"))
    return cut.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    joined = docs.join(line_bitmaps(docs), "doc_id", "left")
    return joined.mapInArrow(_cut(True), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
flagged AS (SELECT k.doc_id, k.i, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS lost FROM keyed k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
