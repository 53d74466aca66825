"""Language identification by rank-order profiles.

Training counts letter n-grams (1 to 3, with word edges) of every labelled document per
language, in Spark, and keeps each language's ``PROFILE`` most frequent ones in rank
order. A document's own most frequent n-grams are compared with each profile by their
out-of-place distance; the nearest language wins, ties go to the first in alphabetical
order. N-grams live in a hash space of 2**16 cells. Profiles hold PROFILE rows a
language; more than ``MAX_LANGUAGES`` labels raise an error, so what goes to the tasks is bounded.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text
if nothing was learned; rows with a null lang teach nothing; doc_id null counts as ''; equal distances go to the
first language and equal counts to the lower cell; extra columns are left out; a long text costs a few arrays of its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import documents

CELLS, PROFILE, MAX_LANGUAGES = 1 << 16, 300, 500
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def gram_cells(text: str | None) -> np.ndarray:
    """The cell of every n-gram of letters in ``text``; n-grams don't cross words."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    seq = np.zeros(len(points) + 2, np.uint32)
    seq[1:-1] = np.where(letter, points, 0)
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)  # one edge between words
    seq = seq[keep]
    solid = seq != 0
    with np.errstate(over="ignore"):
        a = seq * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + a[1:]
        c = (b[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(31) + a[2:]
        cells = [x ^ (x >> np.uint32(15)) for x in (a[solid], b, c[solid[1:-1]])]
        out = np.concatenate(cells) * np.uint32(0x85EBCA6B)
    return (out >> np.uint32(16)).astype(np.int64)


def _counted(batches):
    """Counts of cells per language, given out in whole whenever many languages are held."""
    held: dict[str, np.ndarray] = {}

    def rows():
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "cell", "n"])
        held.clear()

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            held.setdefault(lang, np.zeros(CELLS, np.int64))
            held[lang] += np.bincount(gram_cells(text), minlength=CELLS)
            if len(held) > 64:
                yield from rows()
    yield from rows()


def profiles(train: DataFrame, length: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages of (text, lang) in order and each one's rank per cell; absent cells rank ``length``."""
    counts = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_counted, "lang string, cell long, n long")
    total = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.col("n").desc(), "cell"))
    top = total.withColumn("rank", rank).where(F.col("rank") <= length).select("lang", "cell", "rank")
    found = top.limit(max_languages * length + 1).toPandas()
    langs = sorted(found["lang"].unique())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    ranks = np.full((len(langs), CELLS), length, np.int32)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        ranks[i, own["cell"].to_numpy()] = own["rank"].to_numpy() - 1
    return langs, ranks


def nearest(text: str | None, langs: list[str], ranks: np.ndarray, length: int) -> tuple[str, float]:
    cells = gram_cells(text)
    if not len(cells) or not langs:
        return "und", 0.0
    count = np.bincount(cells, minlength=CELLS)
    at = np.flatnonzero(count)
    at = at[np.argsort(-count[at], kind="stable")[:length]]
    place = np.arange(len(at))
    known = ranks[:, at]
    apart = np.where(known < length, np.abs(known - place), length).sum(axis=1)
    best = int(apart.argmin())
    return langs[best], float(1 - apart[best] / (length * len(at)))


def _predict(langs: list[str], ranks: np.ndarray, length: int):
    def of(batches):
        for b in batches:
            got = [nearest(t, langs, ranks, length) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return of


def identify(docs: DataFrame, langs: list[str], ranks: np.ndarray, length: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of rows (doc_id, held_out, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(langs, ranks, length), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 4 == 2


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    langs, ranks = profiles(docs.where(~F.col("held_out")))
    return identify(docs, langs, ranks)
