"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (A-Z lower-cased, without punctuation at the ends) and their beginnings of 4, 5 and 6 bytes, so that inflected
forms meet. Each distinct term is hashed to one of ``CELLS`` cells; a cell is present or not. The ``USED`` cells that tell most about the
label (by the chi-square statistic, among those that ``SUPPORT`` documents hold) are the features, so that the bulk of a long text's words adds no noise. Spark ML's
factorization machine learns a weight for each and a vector of ``FACTORS`` numbers whose products weigh pairs of cells, such as an insult
with the mention of a group. It is fitted on at most ``SAMPLE`` labelled documents, taken by the hash of their ids.
Scoring is one pass over all texts, whole, with the model's arrays (a number per cell, FACTORS + 1 per feature) as a broadcast.

Defined cases: a null or empty text has no terms and gets the score of the intercept alone; without labelled documents, or with one class only,
every score is the share of toxic labels (0 without any); a doc_id with several labels is toxic if any says so, one with several
texts teaches one of them; null labels teach nothing; rows that repeat are scored each; extra columns are left out; a very
long text is scored whole, at most ``CHUNK`` bytes and one text at a time; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE_BYTES, documents, slice_hashes, stored, text_bytes

CELLS, USED, FACTORS, SAMPLE, SUPPORT = 1 << 20, 4096, 4, 20_000, 3
BEGINNINGS = (4, 5, 6)
#: Rounds of the machine's fit, the size of a step and the pull towards zero.
ITERATIONS, STEP, SHRINK = 100, 0.05, 1e-3
CHUNK = 4 << 20
#: Bytes that end a word: white space and ASCII punctuation.
_ENDS = np.zeros(256, bool)
_ENDS[list(SPACE_BYTES + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


class Model(NamedTuple):
    """Intercept, each cell's feature (-1: none), a weight and a row of factors per feature; ``prior`` instead where nothing could be fitted."""

    intercept: float
    feature: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    prior: float | None = None


def term_cells(texts, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of each text, one text behind the other, and where each text's begin (one more than there are texts)."""
    data, starts, ends = text_bytes(texts)
    data = LOWER[data]
    solid = ~_ENDS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[ends] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(ends, begin, "right")
    hashes, of = [slice_hashes(data, begin, end)], [text]
    for k in BEGINNINGS:
        long = end - begin > k
        hashes.append(slice_hashes(data, begin[long], begin[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        of.append(text[long])
    key = np.unique(np.concatenate(of).astype(np.int64) * cells + (np.concatenate(hashes) % np.uint64(cells)).astype(np.int64))
    return key % cells, np.searchsorted(key // cells, np.arange(len(starts) + 1))


def chunks(batches, most: int = CHUNK):
    """Slices of the batches with about ``most`` bytes of text; a longer text stands alone."""
    for b in batches:
        ends, lo = text_bytes(b.column("text"))[2], 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Label and cells of at most about ``sample`` labelled documents, by the hash of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * sample // n)
    texts = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))

    def of(batches):
        for whole in batches:
            for b in chunks([whole]):
                cell, start = term_cells(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(cell))], names=["label", "cells"])

    return texts.select("label", "text").mapInArrow(of, "label int, cells array<long>")


def telling_cells(rows: DataFrame, n: int, toxic: int, used: int, support: int) -> list[int]:
    """The cells of (label, cells) whose presence has the largest chi-square statistic with the label, in order of number."""
    c = F.col
    per = rows.select("label", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum("label").alias("a"), F.count("*").alias("k")).where(c("k") >= support)
    apart = c("a") * float(n) - c("k") * float(toxic)
    held = c("k") * (F.lit(float(n)) - c("k"))
    return sorted(r.cell for r in per.orderBy((apart * apart / F.when(held > 0, held)).desc_nulls_last(), "cell").limit(used).select("cell").collect())  # USED at most


def fitted(rows: DataFrame, cells: int = CELLS, factors: int = FACTORS, used: int = USED, support: int = SUPPORT) -> Model:
    """The machine learned from (label, cells)."""
    none = np.zeros(0)
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    chosen = telling_cells(rows, n, toxic, used, support) if n and toxic not in (0, n) else []
    if not chosen:
        return Model(0.0, none, none, none, (toxic or 0) / n if n else 0.0)
    feature, size = np.full(cells, -1, np.int32), len(chosen)
    feature[chosen] = np.arange(size)

    @F.udf(VectorUDT())
    def vector(found):
        at = feature[np.array(found, np.int64)]
        at = np.sort(at[at >= 0])
        return SparseVector(size, at, np.ones(len(at)))

    data = rows.select(F.col("label").cast("double").alias("label"), vector("cells").alias("features")).coalesce(8)
    machine = FMClassifier(factorSize=factors, maxIter=ITERATIONS, stepSize=STEP, regParam=SHRINK, initStd=0.05, seed=7, tol=1e-7)
    model = machine.fit(data)
    return Model(model.intercept, feature, model.linear.toArray(), model.factors.toArray())


def logits(model: Model, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Intercept, weights and pairwise products of each text's cells."""
    at = model.feature[cell]
    upto = np.concatenate([[0], np.cumsum(at >= 0)])[start]
    at = at[at >= 0]
    sums = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])[upto], axis=0)
    v = model.factors[at]
    return model.intercept + sums(model.weights[at]) + 0.5 * (np.square(sums(v)) - sums(np.square(v))).sum(axis=1)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of rows (doc_id, held_out, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        m = shared.value
        for whole in batches:
            for b in chunks([whole]):
                p = np.full(len(b), m.prior) if m.prior is not None else 1 / (1 + np.exp(-np.clip(logits(m, *term_cells(b.column("text"), len(m.feature))), -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(of, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    rows = stored(training(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    return scores(docs, fitted(rows))
