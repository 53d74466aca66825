"""Line-first quality rules, DataFrame expressions only.

Every line is judged by itself: punctuation (fragments without a final mark, shouting,
symbol noise), navigation (separator-laden menus) and boilerplate (stock phrases in short
lines). Lines that fail go; a document is rejected when more than ``max_lost`` percent of
its word characters went with them, or when its base counts fail.

Defined cases: a null or empty text has no words and fails the base rule; each row is judged by itself, so repeated rows, ties and
null or repeated doc_ids change nothing; a very long text is judged whole, by one task; an empty table gives no rows; extra columns
are kept by :func:`keep_quality` and left out by :func:`quality_report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 50, 30
#: Stock phrases of web pages, and the longest line (in words) that they condemn.
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign up", "log in", "subscribe to", "enable javascript", "lorem ipsum", "skip to content", "powered by", "share this"]
STOCK_WORDS = 15
FEW = 64  # repeated hashes up to which each word looks itself up among them
_WS = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]+"
_SYMBOL = "[#*$%&|<>]"
_SEPARATOR = "(?:^|[\\x20\\x09-\\x0D])[|»›•·>](?=[\\x20\\x09-\\x0D]|$)"
_SIGN = "[|»›•·>]"
_BLANKS = " \t\n\x0b\x0c\r"
_FINAL = "[.!?:;,…。！？)\"'”’»]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _stock_pattern() -> str:
    """The stock phrases, grouped by their first letter, which most places in a text fail at once."""
    letters = sorted({x[0] for x in BOILERPLATE})
    groups = [f"{a}(?:{'|'.join(x[1:] for x in BOILERPLATE if x[0] == a)})" for a in letters]
    return f"(?=[{''.join(letters)}])(?:{'|'.join(groups)})"


def _line_passes(line: Column, words: Column) -> Column:
    fragment = (words < 5) & ~F.substring(F.rtrim(line, F.lit(_BLANKS)), -1, 1).rlike(_FINAL)
    shouting = _count(line, "[!?]{2}") * 10 > words * 3
    noisy = _count(line, _SYMBOL + "+") * 10 > words * 2
    menu = line.rlike(_SIGN) & (_count(line, _SEPARATOR) * 10 > words)
    stock = (words <= STOCK_WORDS) & F.lower(line).rlike(_stock_pattern())
    return ~(fragment | shouting | noisy | menu | stock)


def _solid(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(text, _WS + "+", ""))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with _tl_n_words, _tl_word_chars, _tl_n_symbols, _tl_n_dup_lines, _tl_n_repeat_words, _tl_kept_chars and
    _tl_kept_text (the lines that pass, and blank ones)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_tl_lines", F.split(text, "\n", -1)).withColumn("_tl_split", F.split(text, _WS + "+", -1))
    head = (F.col("_tl_split")[0] == "").cast("int")
    inner = F.size("_tl_split") - head - ((F.size("_tl_split") > 1) & (F.element_at("_tl_split", -1) == "")).cast("int")
    d = d.withColumn("_tl_w", F.slice("_tl_split", head + 1, F.greatest(inner, F.lit(0))))
    d = d.withColumn("_tl_n_words", F.size("_tl_w").cast("long"))
    w = F.col("_tl_w")
    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_tl_h", F.transform(at, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    h = F.col("_tl_h")
    # hashes that occur twice: none in most texts, which costs a hash set; else from the sorted ones
    d = d.withColumn("_tl_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col("_tl_s")
    d = d.withColumn("_tl_twice", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == s[F.greatest(i - 1, F.lit(0))]))))
    twice = F.col("_tl_twice")
    few = F.filter(at, lambda i: F.array_contains(twice, h[i]))
    # many of them: pairs (hash, place) are sorted instead, and neighbours compared
    d = d.withColumn("_tl_g", F.when(F.size(twice) > FEW, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    g, n = F.col("_tl_g"), F.size(h)
    beside = lambda x, j: F.coalesce(F.get(g, j)["h"] == x["h"], F.lit(False))
    many = F.array_sort(F.transform(F.filter(g, lambda x, i: beside(x, i - 1) | ((i < n - 1) & beside(x, i + 1))), lambda x: x["p"]))
    d = d.withColumn("_tl_p", F.when(twice.isNull(), F.array().cast("array<int>")).when(F.size(twice) <= FEW, few).otherwise(many))
    p = F.col("_tl_p")
    covered = F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(3))).alias("n")))["n"]
    spoken = F.filter("_tl_lines", lambda x: x.rlike(_WORD))
    counted = F.transform("_tl_lines", lambda x: F.struct(x.alias("line"), _count(x, _WORD).alias("n")))  # so that words are counted once a line
    passed = F.filter(counted, lambda x: (x["n"] == 0) | _line_passes(x["line"], x["n"]))
    kept = F.array_join(F.transform(passed, lambda x: x["line"]), "\n")
    d = d.withColumns({
        "_tl_n_repeat_words": covered, "_tl_word_chars": _solid(text).cast("long"),
        "_tl_n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"), "_tl_spoken": spoken, "_tl_kept_text": kept,
    })
    d = d.withColumn("_tl_n_dup_lines", (F.size("_tl_spoken") - F.size(F.array_distinct("_tl_spoken"))).cast("long"))
    d = d.withColumn("_tl_kept_chars", _solid(F.col("_tl_kept_text")).cast("long"))
    return d.drop("_tl_lines", "_tl_split", "_tl_w", "_tl_h", "_tl_s", "_tl_twice", "_tl_g", "_tl_p", "_tl_spoken")


def verdict(measured: DataFrame) -> DataFrame:
    c = F.col
    failed = (c("_tl_n_words") < MIN_WORDS) | (c("_tl_n_repeat_words") * 100 > c("_tl_n_words") * MAX_REPEAT)
    return measured.withColumn("_tl_base_failed", failed).withColumn("_tl_keep", ~failed & ((c("_tl_word_chars") - c("_tl_kept_chars")) * 100 <= c("_tl_word_chars") * MAX_LOST))


def quality_report(docs: DataFrame) -> DataFrame:
    c = verdict(measures(docs.select("doc_id", "text")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return c.select("doc_id", *[F.col(f"_tl_{n}").alias(n) for n in names], F.col("_tl_keep").alias("kept"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns; their texts lose the lines that fail, and n_chars follows.

    Blank lines stay. The row number pins the filter above the measures: pushed below them, it would copy their
    nested expressions into itself and evaluate them once per word.
    """
    judged = verdict(measures(docs)).withColumn("_tl_pin", F.monotonically_increasing_id())
    own = {"text": F.col("_tl_kept_text").alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("_tl_kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return judged.where(F.col("_tl_keep") & (F.col("_tl_pin") >= 0)).select(*[own.get(x, F.col(f"`{x}`")) for x in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


_STOCK_SQL = "|".join(BOILERPLATE)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM g),
r AS (SELECT doc_id, i, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
s AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
j AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
  NOT ((n < 5 AND NOT regexp_matches(line, '[.!?:;,…。！？)"''”’»][\x20\x09-\x0D]*$'))
    OR len(regexp_extract_all(line, '[!?]{{2}}')) * 10 > n * 3 OR len(regexp_extract_all(line, '[#*$%&|<>]+')) * 10 > n * 2
    OR len(regexp_extract_all(regexp_replace(line, '[\x20\x09-\x0D]', '  ', 'g'), '(?:^| )[|»›•·>](?: |$)')) * 10 > n
    OR (n <= {STOCK_WORDS} AND regexp_matches(lower(line), '{_STOCK_SQL}'))) AS passes FROM s),
k AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(solid) FILTER (passes), 0) AS kept FROM j GROUP BY doc_id),
m AS (SELECT d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(k.kept, 0) AS kc
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND (word_chars - kc) * 100 <= word_chars * {MAX_LOST} AS kept
FROM m
"""
