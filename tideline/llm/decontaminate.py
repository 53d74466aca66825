"""Benchmark decontamination by size-partitioned MinHash containment search.

An item counts as leaked into a document that holds at least ``percent`` percent of the
item's distinct shingles. Items are split into size classes (doubling shingle counts), and each class has
a sketch length of its own: one hash more than the shingles which a leaked item of the class's largest size may lack.
An item's sketch is that many of its smallest shingle hashes, so every leaked item shows at least one hash of its
sketch, and the sketch never misses. The sketches of a class lie below the class's ceiling, which falls as sizes grow; a
document searches each class with its shingles below that class's ceiling only, and each hit is then verified on
the full shingle sets.

The item table is counted first: up to ``MAX_BROADCAST`` bytes of shingles its sketches and
sets go to the tasks, above that the same two steps run as shuffled joins.

Defined cases: null or blank texts hold nothing; items of fewer than ``width`` words are one
shingle, which only documents of just these words hold (a phrase so short isn't taken for a leak inside a longer text); rows with a null item_id or doc_id take no part (and stay); repeated rows give a pair once;
extra columns are left out by :func:`leaks` and kept by :func:`drop_leaked`; a long text's shingles are
held by one task at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import documents, stored
from .minhash import sets_of

WIDTH, PERCENT, MAX_BROADCAST = 5, 80, 16 << 20


def _exploded(width: int, names: tuple[str, str]):
    def of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sh, offsets = sets_of(part.column(1), width)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(sh.view(np.int64)), pa.array(np.repeat(n, n))], names=[names[0], names[1], "n"])

    return of


def _rank(h):
    """Hashes ordered as unsigned."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def size_class(n):
    """0 for one shingle, 1 for two and three, and so on."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def sketches(grams: DataFrame, percent: int) -> DataFrame:
    """The sketch rows (item_id, h, n, size_class) of all item shingles (item_id, h, n)."""
    largest = F.pow(F.lit(2.0), size_class(F.col("n")) + 1).cast("long") - 1
    length = F.floor(largest * (100 - percent) / 100) + 1
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy(_rank("h")))
    return grams.withColumn("place", place).where(F.col("place") <= length).select("item_id", "h", "n", size_class(F.col("n")).alias("size_class"))


def _search(ids: list, sizes: np.ndarray, items: np.ndarray, hashes: np.ndarray, classes: list[tuple[np.ndarray, np.ndarray]], width: int, percent: int):
    """Documents against sketches (hashes in order and their items, by size class) and sets that every task holds."""

    def candidates(sh: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        found = set()
        for sketch, item in classes:
            low = np.flatnonzero(sh <= sketch[-1])
            a, b = np.searchsorted(sketch, sh[low], "left"), np.searchsorted(sketch, sh[low], "right")
            for i in np.flatnonzero(b > a):
                found.update((int(owner[low[i]]), int(x)) for x in item[a[i] : b[i]])
        return found

    def of(batches):
        for b in batches:
            docs, found, hit, of_n = [], [], [], []
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sh, offsets = sets_of(part.column(1), width)
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                likely: dict[int, list[int]] = {}
                for d, i in candidates(sh, owner):
                    likely.setdefault(d, []).append(i)
                for d, wanted in sorted(likely.items()):
                    count = np.bincount(items[np.isin(hashes, sh[offsets[d] : offsets[d + 1]])], minlength=len(ids))
                    for i in sorted(wanted):
                        if 100 * count[i] >= percent * sizes[i]:
                            docs.append(at + d), found.append(ids[i]), hit.append(int(count[i])), of_n.append(int(sizes[i]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(found, pa.int64()), pa.array(of_n, pa.int64()), pa.array(hit, pa.int64())], names=["doc_id", "item_id", "n_item", "n_shared"])

    return of


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id, n_item and n_shared (shingles of the item, and those in the document) of every leak."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    tests = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    grams = stored(tests.mapInArrow(_exploded(width, ("item_id", "h")), "item_id long, h long, n long").distinct())
    sketched = sketches(grams, percent)
    if grams.count() * 24 <= max_broadcast:
        g, s = grams.toPandas(), sketched.toPandas()
        ids, at = np.unique(g["item_id"].to_numpy(), return_inverse=True)
        sizes = np.zeros(len(ids), np.int64)
        sizes[at] = g["n"].to_numpy()
        h, sh = g["h"].to_numpy().view(np.uint64), s["h"].to_numpy().view(np.uint64)
        order, by = np.argsort(h), np.argsort(sh)
        item, kind = np.searchsorted(ids, s["item_id"].to_numpy())[by], s["size_class"].to_numpy()[by]
        classes = [(sh[by][kind == x], item[kind == x]) for x in np.unique(kind)]
        run = _search(ids.tolist(), sizes, at[order], h[order], classes, width, percent)
        return texts.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long").distinct()
    ceilings = sketched.groupBy("size_class").agg(F.max(_rank("h")).alias("m")).collect()  # a row per size class, 63 at most
    owned = texts.mapInArrow(_exploded(width, ("doc_id", "h")), "doc_id long, h long, n long").select("doc_id", "h")
    below = F.array_compact(F.array(*[F.when(_rank("h") <= F.lit(r.m), F.lit(r.size_class)) for r in ceilings]))
    asked = owned.select("doc_id", "h", F.explode(below).alias("size_class")) if ceilings else owned.withColumn("size_class", F.lit(0)).limit(0)
    hits = stored(asked.join(sketched, ["size_class", "h"]).select("doc_id", "item_id").distinct())
    wanted = hits.join(grams, "item_id")
    full = wanted.join(owned, ["doc_id", "h"]).groupBy("doc_id", "item_id", F.col("n").alias("n_item")).agg(F.countDistinct("h").alias("n_shared"))
    return full.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    gone = leaks(docs, benchmark, width, percent).select(F.col("doc_id").alias("_tl_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_tl_gone"], "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH src AS (SELECT doc_id AS id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM src),
s AS (SELECT id, kind, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS g FROM w),
i AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 1)
SELECT s.id AS doc_id, i.item_id, i.n AS n_item, count(*) AS n_shared FROM i JOIN s ON s.g = i.g AND s.kind = 0
GROUP BY s.id, i.item_id, i.n HAVING 100 * count(*) >= 80 * i.n
"""
