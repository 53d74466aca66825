"""Phrase collocations by best-first branch and bound.

Phrases grow from their prefixes. A prefix q of count A whose first word has count F bounds
all that grows from it: the cut behind the first word gives floor(2000000 a / (F + r)) with a <= A and r >= a,
which is at most floor(2000000 A / (F + A)). The same holds from the right with the last word. Per language the
frontier is the prefixes whose bound reaches a threshold, at first the score of the ``top``-th best pair of
words; only their extensions are counted. Phrases that score at or above the threshold also have all their extensions by
one word counted, which tell whether they survive (a longer phrase that holds a share of their occurrences
can't be more frequent than the extension between the two). If fewer than ``top`` of a language
survive at or above its threshold, the threshold falls to a score further down and what the
lower one adds to the frontier is expanded; else nothing outside the frontier can reach the ``top``-th
surviving score, ties included, and the language is settled.

Each expansion is a pass over the texts: tasks count n-grams that the frontier admits, Spark sums them by string. Words and pairs of words, which
no bound thins out yet, take a pass before in which only their hashes are summed; those that are rare by it never become strings.
The frontier travels as flags in ``CELLS`` one-byte cells addressed by hash, so its size doesn't grow with
the data; phrases that share a cell only cause more phrases to be counted, never fewer, and every counted phrase is
counted over all texts. Exact counts, scores and cuts come from joins of the counted tables.

Defined cases: a null text is empty, a null lang is ``und``; rows that repeat count again; a language
without candidates gives no rows; ties are ordered by count, then by bytes; extra columns are left out; a very long text is read
whole and costs a few arrays of its length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import LOWER, documents, mix, slice_hashes, stored, text_bytes, window_hashes

LEAST, SHARE, TOP, LONGEST = 30, 80, 2000, 4
#: One-byte cells of a frontier, bytes of text that are counted at a time, and strings that are put together at a time.
CELLS, CHUNK, STRINGS = 1 << 23, 2 << 20, 1 << 16
#: What separates words, and what separates pieces.
BLANKS, CUTS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(CUTS)] = 2
#: Flags of a cell: a counted phrase is here; its extensions to the right, to the left may reach the threshold; it reaches it itself.
KNOWN, RIGHT, LEFT, REACHES = 1, 2, 4, 8


class Words:
    """The words of some texts: slices of the lower-cased bytes, hashes, and where two neighbours don't belong to one piece."""

    def __init__(self, texts, langs):
        data, starts, ends = text_bytes(texts)
        self.data = LOWER[data]
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = edge[ends] = True
        solid = kind == 0
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        of_text = np.searchsorted(ends, self.begin, "right")
        cuts = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int64)])
        self.apart = (cuts[self.begin[1:]] > cuts[self.end[:-1]]) | (of_text[1:] != of_text[:-1])
        found = langs.fill_null("und").dictionary_encode()
        self.langs = found.dictionary
        self.lang = found.indices.to_numpy(zero_copy_only=False)[of_text] if len(of_text) else np.zeros(0, np.int64)
        salt = slice_hashes(*text_bytes(self.langs))
        self.hash, self.salt = slice_hashes(self.data, self.begin, self.end), salt[self.lang]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the ``k`` words from each word on, with their language, and whether one piece holds them."""
        n = max(0, len(self.begin) - k + 1)
        whole = np.ones(n, bool)
        for i in range(k - 1):
            whole &= ~self.apart[i : i + n]
        return mix(window_hashes(self.hash, k) ^ self.salt[:n]), whole

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each word ``at`` on, joined by a space."""
        sizes = [self.end[at + i] - self.begin[at + i] for i in range(k)]
        offsets = np.concatenate([[0], np.cumsum(sum(sizes) + (k - 1))])
        out = np.full(offsets[-1], 32, np.uint8)
        to = offsets[:-1].copy()
        for i, size in enumerate(sizes):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to, size) + step] = self.data[np.repeat(self.begin[at + i], size) + step]
            to += size + 1
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple]:
    """(texts, langs) of about ``most`` bytes each; a longer text is a chunk of its own."""
    for b in batches:
        texts, langs = b.column("text").cast(pa.large_string()), b.column("lang")
        ends, lo = text_bytes(texts)[2], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield texts.slice(lo, hi - lo), langs.slice(lo, hi - lo)
            lo = hi


def admitted(cell: np.ndarray, flags: np.ndarray, all_known: bool) -> np.ndarray:
    """Which pairs of neighbours in ``cell``, each the cell of a (k - 1)-gram, make a k-gram to be counted."""
    f = flags[cell]
    left, right = f[:-1], f[1:]
    known = (left & right & KNOWN) > 0
    grows = ((left & RIGHT) | (right & LEFT)) > 0
    checks = ((left | right) & REACHES) > 0
    return known & (grows | checks) if all_known else (known & grows) | checks


def cells_of(key: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return (key & np.uint64(len(flags) - 1)).astype(np.int64)


def taken(w: Words, k: int, new, old, own) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the ``k``-grams that the broadcast flags ``new`` admit and ``old`` doesn't, with their own cells in ``own``."""
    key, take = w.grams(k)
    if k > 1 and len(key):
        part = w.grams(k - 1)[0]
        cell = cells_of(part, new.value)
        take &= admitted(cell, new.value, k == 3) if k > 2 else (new.value[cell[:-1]] & new.value[cell[1:]] & KNOWN) > 0
        if old is not None:
            take &= ~admitted(cell, old.value, k == 3)
    at = np.flatnonzero(take)
    if own is not None:
        at = at[own.value[cells_of(key[at], own.value)] > 0]
    return key[at], at


def counter(k: int, new=None, old=None, own=None) -> Callable:
    """Counts the ``k``-grams of a chunk of text at a time."""

    def count(batches):
        for texts, langs in chunks(batches):
            w = Words(texts, langs)
            if k == 1:  # also the number of all words, as the count of a null
                total = np.bincount(w.lang, minlength=len(w.langs))
                yield pa.RecordBatch.from_arrays([w.langs, pa.nulls(len(total), pa.string()), pa.array(total, pa.int64())], names=["lang", "phrase", "n"])
            key, at = taken(w, k, new, old, own)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            for lo in range(0, len(n), STRINGS):
                some = at[first[lo : lo + STRINGS]]
                yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[some])), w.strings(some, k), pa.array(n[lo : lo + STRINGS])], names=["lang", "phrase", "n"])

    return count


def hasher(k: int, new=None, old=None) -> Callable:
    """Counts hashes of the ``k``-grams of a chunk of text at a time."""

    def count(batches):
        for texts, langs in chunks(batches):
            key, n = np.unique(taken(Words(texts, langs), k, new, old, None)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return count


def often(docs: DataFrame, k: int, new=None, old=None, size: int = CELLS) -> np.ndarray:
    """Cells of all ``k``-grams that may be found ``LEAST`` times: a pass that sums hashes, so that rare ones never become strings."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(hasher(k, new, old), "key long, n long")
    cell = rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select(F.col("key").bitwiseAND(size - 1).alias("cell"))
    return _gathered(cell.select(F.shiftright("cell", 3).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell").bitwiseAND(7) * 8).cast("int")).alias("bits")), size)


def counts(docs: DataFrame, k: int, new=None, old=None, own=None) -> DataFrame:
    """lang, phrase and count a of the ``k``-grams found ``LEAST`` times or more, and of the null phrase of k = 1."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(counter(k, new, old, own), "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where((F.col("a") >= LEAST) | F.col("phrase").isNull())


def _cells(k: int, size: int) -> Callable:
    """Where the flags of (lang, phrase, flags) lie, eight cells to a long."""

    def of(batches):
        for b in batches:
            w = Words(b.column("phrase"), b.column("lang"))
            cell = w.grams(k)[0][::k] & np.uint64(size - 1)
            bits = b.column("flags").to_numpy(zero_copy_only=False).astype(np.uint64) << ((cell & np.uint64(7)) * np.uint64(8))
            yield pa.RecordBatch.from_arrays([pa.array((cell >> np.uint64(3)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    return of


def flags_of(marked: DataFrame, k: int, size: int = CELLS) -> np.ndarray:
    """The cells of ``marked`` (lang, phrase, flags); at most ``size`` bytes reach the driver."""
    return _gathered(marked.select("lang", "phrase", "flags").where("flags > 0").mapInArrow(_cells(k, size), "slot long, bits long"), size)


def _gathered(rows: DataFrame, size: int) -> np.ndarray:
    got = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 8, np.int64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)) in decimals, since the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.floor(F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(l) + wide(r))).cast("long")


def lowest(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """Score, k, l and r of the lowest-scoring cut, of equal ones the first; null if a part's count isn't known."""
    tried = [F.struct(score(a, l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts, 1)]
    known = tried[0].isNotNull()
    for l, r in cuts:
        known = known & l.isNotNull() & r.isNotNull()
    return F.when(known, F.array_min(F.array(*tried)))


def without_last(k: int) -> Column:
    return F.substring_index("phrase", " ", k - 1)


def without_first(k: int) -> Column:
    return F.substring_index("phrase", " ", -(k - 1))


def scored(found: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """``found`` (lang, phrase, a) of ``k`` words with the cut that counts and the counts of their outer parts.

    first, last: of the first and the last word; head, tail: without the last and without the first word."""
    c = F.col
    part = lambda side: shorter.select(c("lang").alias("lang"), c("phrase").alias(f"_{side}"), *[c(x).alias(f"{side}_{x}") for x in ("a", "first", "last", "head", "tail")])
    d = found.withColumns({"_p": without_last(k), "_s": without_first(k)})
    d = d.join(part("p"), ["lang", "_p"], "left").join(part("s"), ["lang", "_s"], "left")
    cuts = {2: [("p_a", "s_a")], 3: [("p_first", "s_a"), ("p_a", "s_last")], 4: [("p_first", "s_a"), ("p_head", "s_tail"), ("p_a", "s_last")]}[k]
    d = d.withColumn("cut", lowest(c("a"), [(c(x), c(y)) for x, y in cuts]))
    return d.select("lang", "phrase", "a", c("p_first").alias("first"), c("s_last").alias("last"), c("p_a").alias("head"), c("s_a").alias("tail"), c("cut.score").alias("score"), c("cut.l").alias("l"), c("cut.r").alias("r"))


def at_rank(known: DataFrame, ranks: DataFrame) -> DataFrame:
    """lang and a score that at least ``rank`` of its phrases reach, close to the ``rank``-th best; 0 where it has fewer.

    Scores are counted in classes of near ones, some 250 a language, so no task holds all scores of one."""
    c = F.col
    per = known.where("score IS NOT NULL").groupBy("lang", F.floor(F.pow("score", F.lit(0.4))).alias("class")).agg(F.count("*").alias("m"), F.min("score").alias("low"))
    by = per.withColumn("upto", F.sum("m").over(W.Window.partitionBy("lang").orderBy(c("class").desc())))
    return ranks.join(by, "lang", "left").groupBy("lang", "rank").agg(F.coalesce(F.max(F.when(c("upto") >= c("rank"), c("low"))), F.lit(0)).alias("least"))


def marks(known: DataFrame, least: DataFrame) -> DataFrame:
    """Each counted phrase's flags at its language's threshold."""
    flag = lambda ok, bit: F.when(ok, F.lit(bit)).otherwise(0)
    a = F.col("a")
    return known.join(least, "lang").withColumn(
        "flags", F.lit(KNOWN) + flag(score(a, F.col("first"), a) >= F.col("least"), RIGHT) + flag(score(a, a, F.col("last")) >= F.col("least"), LEFT) + flag(F.col("score") >= F.col("least"), REACHES)
    )


def surviving(known: dict[int, DataFrame], least: DataFrame, share: int = SHARE) -> DataFrame:
    """Phrases that reach their language's threshold and whose occurrences no longer phrase holds to ``share`` percent."""
    out = []
    for k in range(2, LONGEST + 1):
        d = known[k].join(least, "lang").where("score >= least").select("lang", "phrase", "a", "l", "r", "score")
        if k < LONGEST:
            longer = known[k + 1].select("lang", F.explode(F.array(without_last(k + 1), without_first(k + 1))).alias("phrase"), F.col("a").alias("m"))
            d = d.join(longer.groupBy("lang", "phrase").agg(F.max("m").alias("m")), ["lang", "phrase"], "left")
            wide = lambda x: F.col(x).cast("decimal(19,0)")
            d = d.where(F.col("m").isNull() | (wide("m") * 100 < wide("a") * share)).drop("m")
        out.append(d)
    return out[0].unionByName(out[1]).unionByName(out[2])


def collocations(docs: DataFrame, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` surviving phrases of two to four words in (lang, text)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    singles = stored(counts(docs, 1, own=share(often(docs, 1, size=cells))))
    totals = singles.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
    a = F.col("a")
    frequent = singles.where("phrase IS NOT NULL").select("lang", "phrase", "a", a.alias("first"), a.alias("last"), a.alias("head"), a.alias("tail"))
    single = share(flags_of(frequent.withColumn("flags", F.lit(KNOWN)), 1, cells))
    known = {2: stored(scored(counts(docs, 2, single, own=share(often(docs, 2, single, size=cells))), frequent, 2))}
    found: dict[int, list[DataFrame]] = {3: [], 4: []}
    seen = {3: None, 4: None}
    ranks = totals.select("lang", F.lit(top).cast("long").alias("rank"))
    while True:
        every = known[2].unionByName(known[3]).unionByName(known[4]) if 4 in known else known[2]
        least = stored(at_rank(every, ranks))
        for k in (3, 4):
            marked = marks(known[k - 1], least)
            flags = flags_of(marked, k - 1, cells)
            flags = flags if seen[k] is None else flags | seen[k].value
            now = share(flags)
            found[k].append(stored(counts(docs, k, now, seen[k])))
            seen[k] = now
            both = found[k][0]
            for more in found[k][1:]:
                both = both.unionByName(more)
            known[k] = stored(scored(both, known[k - 1], k))
        best = stored(surviving(known, least))
        have = best.groupBy("lang").agg(F.count("*").alias("have"))
        reached = known[2].unionByName(known[3]).unionByName(known[4]).join(least, "lang").where("score >= least").groupBy("lang").agg(F.count("*").alias("reached"))
        state = ranks.join(least.select("lang", "least"), "lang").join(have, "lang", "left").join(reached, "lang", "left")
        have = F.coalesce("have", F.lit(0))
        open_ = (have < top) & (F.col("least") > 0)
        further = F.ceil(F.coalesce("reached", "rank") * F.greatest(F.lit(3.0), 2.0 * top / F.greatest(have, F.lit(1)))).cast("long")
        ranks = stored(state.select("lang", F.when(open_, further).otherwise(F.col("rank")).alias("rank"), open_.alias("open")))
        if not ranks.where("open").limit(1).count():
            break
        ranks = ranks.drop("open")
    order = W.Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    close = best.join(at_rank(best, totals.select("lang", F.lit(top).cast("long").alias("rank"))).select("lang", "least"), "lang").where("score >= least")  # little more than is wanted
    first = close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT row_id, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
split AS (SELECT row_number() OVER () AS piece_id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:k], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM cand)),
tried AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = s),
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k > 2))),
most AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN most USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
