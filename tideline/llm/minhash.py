"""MinHash near-dedup with min-max hashing.

A document's set is hashed once under each of ``N_PERMUTATIONS`` permutations and both
the minimum and the maximum are kept, so half as many evaluations give a signature of the
same length; minima and maxima fill separate bands. Documents with equal sets fall into
one class first. Classes that share a band meet in a bucket, where each is linked to the
bucket's smallest member instead of to all others; candidate links are confirmed on full
sets. Members of buckets that end in different components meet again at their rarest shingles: a few turns each with one
set of the shingle's largest component, which brings large clusters together, then all pairs across components that are left.

Defined cases: a null or blank text has an empty set and is linked with nothing; one or two
words form one shingle; a null doc_id takes no part and is its own component; rows that
repeat a doc_id with the same text are one document; extra columns are left out; a long text's set is held by one
task at a time, as eight bytes a shingle.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import BASE, LOWER, dealt_join, documents, mix, slice_hashes, stored, text_bytes, words
from .components import components

WIDTH, PERCENT = 3, 85
N_PERMUTATIONS, ROWS = 120, 6  # 240 values in 40 bands: a pair at 0.85 misses all of them once in 10**8
TURNS = 3  # of single pairs before all that are left
ROWS_A_FILE = 4000  # documents for each file of a table on the way, so that small inputs don't end in very many files


def sets_of(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column, end to end, and the offsets."""
    data, starts, ends = text_bytes(texts)
    data = LOWER[data]
    begin, end, n = words(data, starts, ends)
    word = slice_hashes(data, begin, end)
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        full = mix_windows(word, width)
        inside = owner[: len(full)] == owner[width - 1 :] if len(full) else np.zeros(0, bool)
        sh, doc = full[inside], owner[: len(full)][inside]
        first = np.cumsum(n) - n
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = n[short] > j
                own[has] = own[has] * BASE + word[first[short[has]] + j]
            sh, doc = np.r_[sh, mix(own + n[short].astype(np.uint64))], np.r_[doc, short]
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    keep = np.r_[True, (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])] if len(sh) else np.zeros(0, bool)
    sh, doc = sh[keep], doc[keep]
    return sh, np.searchsorted(doc, np.arange(len(n) + 1))


def mix_windows(word: np.ndarray, width: int) -> np.ndarray:
    if len(word) < width:
        return np.zeros(0, np.uint64)
    n = len(word) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * BASE + word[j : n + j]
    return mix(out)


def _keys(n_permutations: int) -> np.ndarray:
    return mix(np.arange(1, n_permutations + 1, dtype=np.uint64) * BASE)


def band_keys(sh: np.ndarray, offsets: np.ndarray, n_permutations: int = N_PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """A key for each non-empty set and band; bands of minima first, then bands of maxima."""
    at = offsets[:-1]
    out = np.empty((len(at), 2 * n_permutations), np.uint64)
    with np.errstate(over="ignore"):
        for i, k in enumerate(_keys(n_permutations)):
            # an odd multiplier permutes 64-bit values; the shift lets high bits reach the low ones
            x = (sh ^ (sh >> np.uint64(29))) * (k | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            out[:, i], out[:, n_permutations + i] = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
        bands = out.reshape(len(at), -1, rows)
        key = np.zeros(bands.shape[:2], np.uint64)
        for j in range(rows):
            key = mix(key * BASE + bands[:, :, j])
        return mix(key + np.arange(bands.shape[1], dtype=np.uint64) * BASE)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signatures(width: int, n_permutations: int, rows: int):
    def of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sh, offsets = sets_of(part.column(1), width)
                n = np.diff(offsets)
                full = np.flatnonzero(n > 0)
                n_bands = 2 * n_permutations // rows
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                flat = np.zeros(0, np.int64)
                if len(full):
                    starts = offsets[full]
                    with np.errstate(over="ignore"):
                        s1[full], s2[full] = np.add.reduceat(sh, starts), np.add.reduceat(mix(sh ^ BASE), starts)
                    flat = band_keys(sh, np.r_[starts, len(sh)], n_permutations, rows).view(np.int64).ravel()
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, (n > 0) * n_bands]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), bands], schema=_SIGNED)

    return of


def _set_rows(width: int):
    def of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sh, offsets = sets_of(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sh[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "sh"])

    return of


def _confirmed(percent: int, names: list[str]):
    def of(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    return of


def can_reach(x: str, y: str, percent: int):
    """Whether sets of so many shingles can reach the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, hot: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The rows of stored ``pairs`` (a, b, ...) whose full sets (id, sh) reach the similarity.

    ``hot`` names the ends at which one set may stand in very many pairs: such a set (a large cluster's pivot) is sent to each of
    several tasks, which share its pairs."""
    full = pairs
    for end, name in (("b", "y"), ("a", "x")):
        side = sets.select(F.col("id").alias(end), F.col("sh").alias(name))
        other = "a" if end == "b" else "b"
        full = dealt_join(full, side, [end], other, pairs.groupBy(end).agg(F.count("*").alias("n"))) if end in hot else full.join(side, end)
    return full.mapInArrow(_confirmed(percent, pairs.columns), ", ".join(f"{c} long" for c in pairs.columns))


def _tokens(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            sh = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("sh")]
            size = np.array([len(x) for x in sh])
            at = np.repeat(np.arange(len(sh)), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sh)), b.column("id").take(pa.array(at)), pa.array(size[at])], names=["token", "id", "n"])


def prefix_rows(sets: DataFrame, percent: int, parts: int | None = None) -> DataFrame:
    """(token, id, n, p) of the shingles among which every set (id, sh) shares one with each set that it can reach the similarity with.

    An id stands in one row of ``sets``. Two sets that similar share one of the first n - ceil(n * percent / 100) + 1 shingles of
    any common order; rare shingles come first here, by their exact counts over ``sets``. p is a shingle's place, n the set's size.
    """
    c = F.col
    all_ = stored(sets.select("id", "sh").mapInArrow(_tokens, "token long, id long, n long"), parts)
    held = stored(all_.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), parts)  # a shingle of one set makes no pair
    ranked = all_.join(held.select("token", c("n").alias("held")), "token", "left")
    place = F.row_number().over(W.Window.partitionBy("id").orderBy(F.coalesce("held", F.lit(1)), "token")) - 1
    rows = ranked.withColumn("p", place).where(c("p") <= c("n") - F.ceil(c("n") * percent / 100)).where("held IS NOT NULL")
    return stored(rows.select("token", "id", "n", "p"), parts)


def split_tokens(rows: DataFrame, comps: DataFrame, turn: int, parts: int | None = None) -> DataFrame:
    """The rows of tokens that several components share, with the set's component (comp), the token's largest (main) and a set of it (pivot, n_pivot; another for each token and turn)."""
    own = stored(rows.select("token", "id", "n", "p").join(comps, "id"), parts)
    pick = F.min(F.struct(F.xxhash64("id", "token", F.lit(turn)).alias("h"), F.col("id").alias("pivot"), F.col("n").alias("n_pivot"))).alias("pick")
    per = own.groupBy("token", "comp").agg(F.count("*").alias("k"), pick)
    best = per.groupBy("token").agg(F.max(F.struct("k", "comp", "pick")).alias("b"), F.count("*").alias("m")).where("m > 1")
    largest = stored(best.select("token", F.col("b.comp").alias("main"), "b.pick.pivot", "b.pick.n_pivot"), parts)
    return stored(own.join(largest, "token"), parts)


def pivot_pairs(split: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a set inside a token's largest component with one outside it, and their components: a row per set and token at most."""
    can = (F.col("comp") != F.col("main")) & can_reach("n", "n_pivot", percent)
    return split.where(can).select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("main").alias("comp_a"), F.col("comp").alias("comp_b")).distinct()


def meeting_pairs(split: DataFrame, percent: int) -> DataFrame:
    """All distinct pairs (a, b) in different components that can reach the similarity. Pairs
    meet at a shingle only if one of them lies outside the shingle's largest component, so
    a large component is never joined with itself."""
    c = F.col
    l, r = split.where("comp <> main").alias("l"), split.alias("r")
    least = F.floor((percent * (c("l.n") + c("r.n")) + 99 + percent) / (100 + percent))
    can = (c("l.comp") != c("r.comp")) & can_reach("l.n", "r.n", percent) & (F.least(c("l.n") - c("l.p"), c("r.n") - c("r.p")) >= least)
    first = c("l.id") < c("r.id")
    ends = [F.when(first, c(f"{x}.{k}")).otherwise(c(f"{y}.{k}")).alias(name) for x, y, k, name in (("l", "r", "id", "a"), ("r", "l", "id", "b"), ("l", "r", "comp", "comp_a"), ("r", "l", "comp", "comp_b"))]
    return l.join(r, (c("l.token") == c("r.token")) & can).select(*ends).distinct()


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """:func:`meeting_pairs` of rows (id, comp, sh); rows that repeat an id are one set."""
    sets = sets.dropDuplicates(["id"])
    return stored(meeting_pairs(split_tokens(prefix_rows(sets, percent), sets.select("id", "comp"), 0), percent))


def merged(comps: DataFrame, links: DataFrame, parts: int | None = None) -> DataFrame:
    """``comps`` (id, comp) after joining the components (comp_a, comp_b) of ``links``."""
    into = components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), parts).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return stored(comps.join(into, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp")), parts)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, n_permutations: int = N_PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Joins of narrow rows (a few integers each) leave hot keys to adaptive execution, which splits a partition by its bytes; where a join brings
    sets to its rows, which bytes before the join don't show, hot keys are dealt out beforehand (:func:`confirm`).
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(texts.mapInArrow(_signatures(width, n_permutations, rows), "doc_id long, n long, s1 long, s2 long, bands array<long>"))
    parts = math.ceil((signed.count() + 1) / ROWS_A_FILE)
    keep = functools.partial(stored, parts=parts)
    some = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = keep(signed.where(some).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    own = signed.where(some).drop("bands").join(classes, ["s1", "s2"])
    alone = signed.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "n", F.col("doc_id").alias("rep"))
    members = keep(own.select("doc_id", "n", "rep").unionByName(alone))
    reps = classes.select(F.col("rep").alias("doc_id"))
    banded = signed.where(some).select("doc_id", "n", "bands").join(reps, "doc_id", "left_semi").select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "n")
    first = F.min(F.struct(F.col("id").alias("pivot"), F.col("n").alias("n_pivot"))).alias("first")
    buckets = keep(banded.groupBy("key").agg(first, F.max("id").alias("top"), F.count("*").alias("m")).where("first.pivot < top").select("key", "first.*", "m"))
    met = keep(banded.join(buckets, "key"))
    stars = keep(met.where((F.col("id") != F.col("pivot")) & can_reach("n", "n_pivot", percent)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    ids = met.select("id").distinct()
    sets = keep(texts.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").mapInArrow(_set_rows(width), "id long, sh binary").dropDuplicates(["id"]))
    linked = keep(confirm(stars, sets, percent, ("a",)))  # a set is in as many buckets as there are bands at most, so b isn't hot
    found = components(linked, parts).withColumnRenamed("node", "id")
    comps = keep(sets.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    open_ = keep(met.where("m > 2").select("key", "id").join(comps, "id"))
    split = keep(open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    again = keep(open_.join(split, "key").select("id").distinct())
    prefixes = prefix_rows(sets.join(again, "id", "left_semi"), percent, parts)
    # large clusters of near copies come together by single pairs first, so that few sets are left outside them
    for turn in range(TURNS):
        prefixes = split_tokens(prefixes, comps, turn, parts)
        more = keep(confirm(keep(pivot_pairs(prefixes, percent)), sets, percent, ("a",)))  # b has a pair per shingle of its own at most
        if more.isEmpty():
            break
        comps = merged(comps, more, parts)
    more = keep(confirm(keep(meeting_pairs(split_tokens(prefixes, comps, TURNS, parts), percent)), sets, percent))
    if not more.isEmpty():
        comps = merged(comps, more, parts)
    all_ = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    return all_.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_tl_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_tl_gone"], "left_anti")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
t AS (SELECT doc_id, md5(array_to_string(list_sort(s), chr(10))) AS c, len(s) AS n FROM s),
c AS (SELECT c, min(doc_id) AS rep, any_value(n) AS n FROM t WHERE n > 0 GROUP BY c),
g AS (SELECT rep, c.n, hash(unnest(s)) AS g FROM c JOIN s ON s.doc_id = c.rep),
f AS (SELECT rep, n, g, count(*) OVER (PARTITION BY g) AS k FROM g),
p AS (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY k, g) AS r FROM f),
q AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS x, b.n AS y FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  WHERE a.r <= a.n - (85 * a.n + 99) // 100 + 1 AND b.r <= b.n - (85 * b.n + 99) // 100 + 1),
e AS (SELECT q.a, q.b FROM q JOIN g a ON a.rep = q.a JOIN g b ON b.rep = q.b AND b.g = a.g GROUP BY q.a, q.b, q.x, q.y HAVING 100 * count(*) >= 85 * (q.x + q.y - count(*))),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS comp FROM r GROUP BY node)
SELECT t.doc_id, t.n::BIGINT AS n_shingles, coalesce(m.comp, t.doc_id) AS component_id, t.doc_id = coalesce(m.comp, t.doc_id) AS kept
FROM t LEFT JOIN c ON c.c = t.c AND t.n > 0 LEFT JOIN m ON m.node = c.rep
"""
