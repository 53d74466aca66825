"""Documents, ledgers, event windows and gates over the test tables."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.operators import events as E
from tideline.operators import ledger as L
from tideline.operators import quality as Q
from tideline.plans.market import B4, H4, M, bars_4h, pit, read
from tideline.plans.market import O as OS
from tideline.plans.shape import register
from tideline.operators.features import labels

c = F.col


def docs(s: SparkSession, f: str) -> DataFrame:
    d = read(s, f, "documents")
    tags = F.when(c("lang") == "en", F.array(F.lit("BTC"), F.lit("MARKET"))).when(c("lang") == "de", F.array(F.lit("ETH"))).otherwise(F.array().cast("array<string>"))
    return d.select(c("doc_id").alias("document_id"), c("source").alias("source_id"), F.substring("text", 1, 80).alias("title"), "text", "lang", F.timestamp_seconds(F.lit(1704067200) + c("doc_id") * 60).alias("retrieved_at"), F.sha2("text", 256).alias("content_sha256"), tags.alias("asset_tags"))


def signals(s: SparkSession, f: str, e: DataFrame | None = None) -> DataFrame:
    """Signals of the events, or of a stream of them."""
    e, n = read(s, f, "events") if e is None else e, read(s, f, "documents").agg(F.count("*").alias("n_docs"))  # one row
    t = c("ts").cast("timestamp")
    k = c("event_type")
    return e.crossJoin(n).select(
        c("event_id").alias("signal_id"), F.concat(F.lit("k"), c("event_id")).alias("extraction_key"), F.pmod("event_id", "n_docs").alias("document_id"), F.concat(F.lit("src"), c("user_id") % 7).alias("source_id"),
        F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "MARKET"))), (c("event_id") % 3 + 1).cast("int")).alias("asset"), k.alias("event_type"), F.when(k.isin("purchase", "signup"), "bullish").when(k == "error", "bearish").otherwise("neutral").alias("direction"),
        F.least(c("value") / 500, F.lit(1.0)).alias("severity"), (c("event_id") % 10 / 10.0).alias("novelty"), ((c("user_id") % 5 + 1) / 5.0).alias("confidence"), F.lit(0.8).alias("source_quality"), t.alias("event_time"),
        F.timestamp_micros(F.unix_micros(t) + c("event_id") % 60 * 60_000_000).alias("available_at"),
    )


def calls(s: SparkSession, f: str) -> DataFrame:
    d = signals(s, f).withColumn("value", c("severity") * 500)
    return d.select(
        c("signal_id").alias("call_id"), "extraction_key", "source_id", F.when(c("signal_id") % 23 == 0, "failed").otherwise("success").alias("status"), (c("signal_id") % 3 + 1).alias("attempts"), c("available_at").alias("started_at"),
        F.timestamp_micros(F.unix_micros("available_at") + (c("signal_id") % 5 + 1) * 500_000).alias("completed_at"), F.floor("value").alias("tokens"), F.when(c("signal_id") % 46 == 0, "timeout").alias("error_code"), (c("signal_id") % 4).cast("int").alias("run"),
    )


DOCS = "SELECT doc_id AS document_id, source AS source_id, left(text, 80) AS title, text, lang, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS retrieved_at, sha256(text) AS content_sha256, CASE lang WHEN 'en' THEN ['BTC', 'MARKET'] WHEN 'de' THEN ['ETH'] ELSE [] END AS asset_tags FROM documents"
SIG = "SELECT event_id AS signal_id, 'k' || event_id AS extraction_key, event_id % (SELECT count(*) FROM documents) AS document_id, 'src' || (user_id % 7) AS source_id, ['BTC', 'ETH', 'MARKET'][event_id % 3 + 1] AS asset, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS direction, least(value / 500, 1.0) AS severity, (event_id % 10) / 10.0::DOUBLE AS novelty, (user_id % 5 + 1) / 5.0::DOUBLE AS confidence, 0.8::DOUBLE AS source_quality, ts AS event_time, ts + to_minutes(event_id % 60) AS available_at, user_id FROM events"
CALLS = f"SELECT signal_id AS call_id, extraction_key, source_id, CASE WHEN signal_id % 23 = 0 THEN 'failed' ELSE 'success' END AS status, signal_id % 3 + 1 AS attempts, available_at AS started_at, available_at + to_milliseconds((signal_id % 5 + 1) * 500) AS completed_at, floor(severity * 500)::BIGINT AS tokens, CASE WHEN signal_id % 46 = 0 THEN 'timeout' END AS error_code, signal_id % 4 AS run FROM ({SIG})"
INC, EXC = ["the", "der", "idiot"], ["scum", "moron"]
IDSQL = lambda *p: "sha256(" + " || ".join(f"strlen(coalesce(({x})::VARCHAR, ''))::VARCHAR || ':' || coalesce(({x})::VARCHAR, '')" for x in p) + ")"

# documents
HOST = r"trim(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '.')"
CU = rf"""SELECT *, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END
  || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(kept), lambda p: replace(url_encode(p['k']), '%20', '+') || '=' || replace(url_encode(p['v']), '%20', '+')), '&') END END AS canonical
FROM (SELECT *, list_filter(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: {{
    'k': url_decode(replace(string_split(p, '=')[1], '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, position('=' IN p) + 1) ELSE '' END, '+', ' '))}}),
    lambda p: NOT starts_with(lower(p['k']), 'utm_') AND NOT list_contains({X.TRACKING}, lower(p['k']))) AS kept
  FROM (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, {HOST} AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages))"""
register("c10_canonical_url", lambda s, f: read(s, f, "pages").withColumn("canonical", X.canonical_url(c("url"))), "page_id:i canonical", CU)
DOMS = ["example.com", "example.org"]
register("b10_c11_hosts", lambda s, f: read(s, f, "pages").withColumns({"host": X.host_of(c("url")), "allowed": X.host_allowed(X.host_of(c("url")), DOMS), "public": X.public_host(X.host_of(c("url")))}), "page_id:i host allowed public", f"SELECT page_id, h AS host, {' OR '.join(f'h = {d!r} OR ends_with(h, {chr(39)}.{d}{chr(39)})' for d in DOMS)} AS allowed, h <> '' AS public FROM (SELECT *, {HOST} AS h FROM pages)")
TAGLESS = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gsi'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""
register("c9_tagless", lambda s, f: read(s, f, "pages").withColumn("body", X.tagless(c("html"))).withColumns({"n": F.length("body"), "sha": F.sha2("body", 256)}), "page_id:i n:i sha",
         r"SELECT page_id, length(b) AS n, sha256(b) AS sha FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gsi'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM pages)")
quoted = lambda x: "'" + x.replace("'", "''") + "'" if x.isprintable() else "concat(" + ", ".join(f"chr({ord(y)})" for y in x) + ")" if x else "''"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: HTML's character references, as Python's html module has them: the names, and the numbers that don't stand for themselves.
NAMED = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in html.entities.html5.items())
NUMBERED = ", ".join(f"({n}, {quoted(html.unescape(f'&#{n};'))})" for n in [*range(32), *range(127, 160), *range(0xFDD0, 0xFDF0), *[p * 0x10000 + x for p in range(17) for x in (0xFFFE, 0xFFFF)]])
#: A reference is a number, the longest name that its text begins with (the semicolon may lack where HTML lets it), or stays; each is decoded once.
STRIPPED = rf"""WITH named(k, v) AS (VALUES {NAMED}), numbered(n, v) AS (VALUES {NUMBERED}),
  bare AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script[\s\x0B]*>|<style\b[^>]*>.*?</style[\s\x0B]*>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'), '[\s\x0B]+', ' ', 'g')) AS b FROM pages),
  pieces AS (SELECT page_id, unnest(regexp_extract_all(b, '{REFERENCE}|[^&]+|&')) AS x, generate_subscripts(regexp_extract_all(b, '{REFERENCE}|[^&]+|&'), 1) AS i FROM bare WHERE b IS NOT NULL),
  refs AS (SELECT DISTINCT x FROM pieces WHERE regexp_full_match(x, '{REFERENCE}')),
  numbers AS (SELECT x, CASE WHEN x[3] IN ('x', 'X') THEN TRY_CAST('0x' || d AS BIGINT) ELSE TRY_CAST(d AS BIGINT) END AS n FROM (SELECT x, coalesce(nullif(ltrim(rtrim(regexp_replace(x, '^&#[xX]?', ''), ';'), '0'), ''), '0') AS d FROM refs WHERE x LIKE '&#%')),
  decoded AS (SELECT x, CASE WHEN numbered.n IS NOT NULL THEN v WHEN numbers.n IS NULL OR numbers.n > 1114111 OR numbers.n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(numbers.n::INT) END AS y FROM numbers LEFT JOIN numbered ON numbered.n = numbers.n
    UNION ALL SELECT x, arg_max(v || substr(x, 2 + length(k)), length(k)) AS y FROM (SELECT x, substr(x, 2, unnest(range(2, length(x)))) AS k FROM refs WHERE x NOT LIKE '&#%') JOIN named USING (k) GROUP BY x)
SELECT page_id, CASE WHEN b IS NULL THEN NULL ELSE trim(regexp_replace(coalesce(text, ''), '[\t-\r\x1C-\x20\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) END AS body
FROM bare LEFT JOIN (SELECT page_id, string_agg(coalesce(y, x), '' ORDER BY i) AS text FROM pieces LEFT JOIN decoded USING (x) GROUP BY page_id) USING (page_id)"""
register("c9_strip_markup", lambda s, f: read(s, f, "pages").withColumn("body", X.strip_markup(c("html"))), "page_id:i body", STRIPPED)
register("c8_relevance_text", lambda s, f: docs(s, f).withColumn("folded", X.folded(F.concat_ws("\n", "title", "text"))).select("document_id", F.sha2("folded", 256).alias("sha")), "document_id:i sha",
         rf"SELECT document_id, sha256(trim(regexp_replace(replace(lower(concat_ws(chr(10), title, text)), 'ß', 'ss'), '\s+', ' ', 'g'))) AS sha FROM ({DOCS})")  # of texts whose characters are composed already, as here


def decisions(s: SparkSession, f: str) -> DataFrame:
    d = docs(s, f).withColumn("r", X.relevance(F.concat_ws("\n", "title", "text"), INC, EXC))
    return d.select("document_id", "source_id", "retrieved_at", "title", "content_sha256", "r.accepted", "r.reason", F.array_join("r.included", ",").alias("included"), F.array_join("r.excluded", ",").alias("excluded"))


DEC = f"""SELECT *, reason LIKE 'accepted%' AS accepted FROM (SELECT *, array_to_string(i, ',') AS included, array_to_string(x, ',') AS excluded, CASE WHEN len(x) > 0 THEN 'rejected_excluded_term' WHEN len(i) = 0 THEN 'rejected_missing_include_term' ELSE 'accepted_include_match' END AS reason FROM (SELECT *, list_filter({INC}, lambda t: contains(folded, t)) AS i, list_filter({EXC}, lambda t: contains(folded, t)) AS x
  FROM (SELECT *, trim(regexp_replace(lower(concat_ws(chr(10), title, text)), '\\s+', ' ', 'g')) AS folded FROM ({DOCS}))))"""
register("b8_relevance", decisions, "document_id:i accepted reason included excluded", DEC)
register("c13_identities", lambda s, f: docs(s, f).select("document_id", X.identity(c("source_id"), c("title"), c("content_sha256")).alias("identity")), "document_id:i identity", f"SELECT document_id, {IDSQL('source_id', 'title', 'content_sha256')} AS identity FROM ({DOCS})")
register("c14_whole_text_classes", lambda s, f: docs(s, f).withColumn("k", X.classify(F.concat_ws("\n", "title", "text"))).select("document_id", "k.*"), "document_id:i event_type severity:d horizon",
         "SELECT *, CASE WHEN severity >= 0.6 THEN '1d_3d' ELSE '1w_plus' END AS horizon FROM (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for _, k, v in X.EVENT_RULES) + " ELSE 0.2 END AS severity FROM (SELECT document_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{k}'" for ws, k, _ in X.EVENT_RULES) + f" ELSE 'general_update' END AS event_type FROM (SELECT document_id, lower(concat_ws(chr(10), title, text)) AS t FROM ({DOCS}))))")
register("c19_document_text", lambda s, f: docs(s, f).withColumn("body", X.document_text(c("title"), c("text"))).select("document_id", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("sha")), "document_id:i n_bytes:i sha", f"SELECT document_id, strlen(b) AS n_bytes, sha256(b) AS sha FROM (SELECT document_id, CASE WHEN text = '' THEN title ELSE title || chr(10) || chr(10) || text END AS b FROM ({DOCS}))")
register("c20_slugs", lambda s, f: read(s, f, "pages").withColumn("slug", X.slug(c("url"))), "page_id:i slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
register("c12_feed_times", lambda s, f: docs(s, f).withColumn("raw", F.when(c("document_id") % 3 == 0, F.date_format("retrieved_at", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).when(c("document_id") % 3 == 1, F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss"))).withColumn("published_at", X.feed_time(c("raw"), F.timestamp_micros(F.unix_micros("retrieved_at") - F.when(c("document_id") % 5 == 0, 600_000_000).otherwise(0)), 300)), "document_id:i published_at:t", f"SELECT document_id, CASE WHEN document_id % 3 <> 2 AND document_id % 5 <> 0 THEN retrieved_at END AS published_at FROM ({DOCS})")


def spoiled_docs(s: SparkSession, f: str) -> DataFrame:
    """Documents with some hashes and tags broken on purpose."""
    twice = F.array(F.lit("BTC"), F.lit("BTC"))
    return docs(s, f).withColumns({"content_sha256": F.when(c("document_id") % 97 == 5, F.lit("x")).otherwise(c("content_sha256")), "asset_tags": F.when(c("document_id") % 41 == 3, twice).otherwise(c("asset_tags"))})


SPOILED = f"SELECT * REPLACE (CASE WHEN document_id % 97 = 5 THEN 'x' ELSE content_sha256 END AS content_sha256, CASE WHEN document_id % 41 = 3 THEN ['BTC', 'BTC'] ELSE asset_tags END AS asset_tags) FROM ({DOCS})"
register("b13_document_contract", lambda s, f: Q.violations(spoiled_docs(s, f), {"hash_differs": c("content_sha256") != F.sha2("text", 256), "empty_text": F.length("text") == 0, "tags_repeat": F.size(F.array_distinct("asset_tags")) != F.size("asset_tags"), "no_tags": F.size("asset_tags") == 0}, ["source_id"]), "source_id rule violations:i",
         " UNION ALL ".join(f"SELECT source_id, '{n}' AS rule, count(*) FILTER ({e}) AS violations FROM ({SPOILED}) GROUP BY 1" for n, e in {"hash_differs": "content_sha256 <> sha256(text)", "empty_text": "length(text) = 0", "tags_repeat": "len(list_distinct(asset_tags)) <> len(asset_tags)", "no_tags": "len(asset_tags) = 0"}.items()))
register("b19_credential_scan", lambda s, f: docs(s, f).groupBy("source_id").agg(F.count_if(c("text").rlike(X.SECRET)).alias("hits"), F.count("*").alias("rows")), "source_id hits:i rows:i", rf"SELECT source_id, count(*) FILTER (regexp_matches(text, '{X.SECRET}')) AS hits, count(*) AS rows FROM ({DOCS}) GROUP BY 1")
register("e25_duplicate_content", lambda s, f: docs(s, f).groupBy("content_sha256").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("k")).where("k > 1").agg(F.sum(c("n") - 1).alias("duplicates"), F.count("*").alias("texts")), "duplicates:i texts:i", f"SELECT sum(n - 1) AS duplicates, count(*) AS texts FROM (SELECT count(*) AS n, count(DISTINCT source_id) AS k FROM ({DOCS}) GROUP BY content_sha256) WHERE k > 1")
register("e26_e37_capture_counts", lambda s, f: decisions(s, f).groupBy("source_id").agg(F.count("*").alias("parsed"), F.count_if("accepted").alias("accepted"), F.count_if(~c("accepted")).alias("rejected")), "source_id parsed:i accepted:i rejected:i", f"SELECT source_id, count(*) AS parsed, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM ({DEC}) GROUP BY 1")
register("b21_reconciliation", lambda s, f: decisions(s, f).groupBy("source_id").agg(F.count("*").alias("decided"), F.count_if("accepted").alias("a"), F.count_if(~c("accepted")).alias("r")).join(docs(s, f).groupBy("source_id").agg(F.count("*").alias("parsed")), "source_id", "fullouter").agg(F.count_if(~c("decided").eqNullSafe(c("parsed"))).alias("undecided"), F.count_if(c("a") + c("r") != c("decided")).alias("uneven"), F.sum("decided").alias("total")), "undecided:i uneven:i total:i", f"SELECT 0 AS undecided, 0 AS uneven, count(*) AS total FROM ({DEC})")
ORDER = ["src3", "src1"]
register("g4_round_robin", lambda s, f: L.select_round_robin(decisions(s, f).where("accepted"), "source_id", ["retrieved_at", "document_id"], ORDER, 50), "document_id:i source_id turn:i", f"SELECT document_id, source_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at, document_id) AS turn, CASE source_id WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS sr FROM ({DEC}) WHERE accepted) ORDER BY turn, sr, source_id LIMIT 50")
register("g5_global_order", lambda s, f: decisions(s, f).where("accepted").orderBy("retrieved_at", "source_id", "document_id").limit(25), "document_id:i source_id retrieved_at:t", f"SELECT * FROM ({DEC}) WHERE accepted ORDER BY retrieved_at, source_id, document_id LIMIT 25")
register("g6_item_cap", lambda s, f: L.round_robin(docs(s, f), "source_id", ["document_id"], [], 100_000).groupBy("source_id").agg(F.count_if(c("turn") <= 10).alias("kept"), F.count_if(c("turn") > 10).alias("truncated")), "source_id kept:i truncated:i", f"SELECT source_id, least(count(*), 10) AS kept, greatest(count(*) - 10, 0) AS truncated FROM ({DOCS}) GROUP BY 1")

# ledgers
def ledger(s: SparkSession, f: str) -> DataFrame:
    return L.chain(docs(s, f).select("source_id", "document_id", "retrieved_at", "content_sha256"), "source_id", ["retrieved_at", "document_id"], c("content_sha256"))


LED = f"SELECT *, lag(sha) OVER (PARTITION BY source_id ORDER BY seq) AS prev_sha FROM (SELECT *, sha256(source_id || '|' || seq || '|' || content_sha256) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at, document_id) AS seq FROM ({DOCS})))"
register("d12_chain", ledger, "source_id document_id:i seq:i sha prev_sha", LED)
register("d12_f14_chain_report", lambda s, f: L.chain_report(ledger(s, f).withColumn("prev_sha", F.when(c("document_id") % 97 == 5, F.lit("x")).otherwise(c("prev_sha"))), "source_id"), "source_id rows:i roots:i broken:i disordered:i forks:i", f"""WITH t AS (SELECT * REPLACE (CASE WHEN document_id % 97 = 5 THEN 'x' ELSE prev_sha END AS prev_sha) FROM ({LED})), k AS (SELECT source_id, sum((n > 1)::INT) AS forks FROM (SELECT source_id, prev_sha, count(*) AS n FROM t WHERE prev_sha IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT t.source_id, count(*) AS rows, count(*) FILTER (t.prev_sha IS NULL) AS roots, count(*) FILTER (t.prev_sha IS NOT NULL AND p.sha IS NULL) AS broken, count(*) FILTER (p.seq >= t.seq) AS disordered, coalesce(any_value(forks), 0) AS forks FROM t LEFT JOIN t p ON p.source_id = t.source_id AND p.sha = t.prev_sha LEFT JOIN k ON k.source_id = t.source_id GROUP BY 1""")


def extracted(s: SparkSession, f: str) -> DataFrame:
    """The document of every successful call, found by the extraction key that both tables hold."""
    return calls(s, f).where("status = 'success'").join(signals(s, f).select("extraction_key", "document_id"), "extraction_key").select("document_id")


register("d11_pending_extraction", lambda s, f: L.unseen(docs(s, f).select("document_id", "source_id"), extracted(s, f), ["document_id"]), "document_id:i source_id",
         f"SELECT document_id, source_id FROM ({DOCS}) ANTI JOIN (SELECT g.document_id FROM ({CALLS}) k JOIN ({SIG}) g USING (extraction_key) WHERE k.status = 'success') USING (document_id)")
register("h3_first_wins", lambda s, f: L.first_wins(signals(s, f).select("document_id", "signal_id", "asset"), ["document_id"], ["signal_id"], ["asset"])[0], "document_id:i signal_id:i asset", f"SELECT document_id, min(signal_id) AS signal_id, arg_min(asset, signal_id) AS asset FROM ({SIG}) GROUP BY 1")
register("h3_conflicts", lambda s, f: L.first_wins(signals(s, f), ["document_id"], ["signal_id"], ["asset"])[1], "document_id:i payloads:i", f"SELECT document_id, count(DISTINCT asset) AS payloads FROM ({SIG}) GROUP BY 1 HAVING count(DISTINCT asset) > 1")
register("d13_dangling", lambda s, f: L.dangling(calls(s, f).select("call_id", "extraction_key"), signals(s, f).where("asset <> 'ETH'"), ["extraction_key"]), "call_id:i extraction_key", f"SELECT call_id, extraction_key FROM ({CALLS}) WHERE extraction_key NOT IN (SELECT extraction_key FROM ({SIG}) WHERE asset <> 'ETH')")
register("d18_lineage", lambda s, f: L.disagreeing(signals(s, f).select(c("signal_id").alias("call_id"), F.when(c("signal_id") % 31 == 0, "srcX").otherwise(c("source_id")).alias("source_id")), calls(s, f), ["call_id"], ["source_id"]), "call_id:i source_id", f"SELECT signal_id AS call_id, 'srcX' AS source_id FROM ({SIG}) WHERE signal_id % 31 = 0")
register("h4_set_differences", lambda s, f: docs(s, f).groupBy("lang").agg(F.collect_set("source_id").alias("x")).select("lang", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ("src0", "src99", "web"))), "x")), ",").alias("missing"), F.array_join(F.array_sort(F.array_intersect(F.array(*map(F.lit, ("src0", "src1"))), "x")), ",").alias("present")), "lang missing present", f"SELECT lang, array_to_string(list_sort(list_filter(['src0', 'src99', 'web'], lambda v: NOT list_contains(x, v))), ',') AS missing, array_to_string(list_sort(list_filter(['src0', 'src1'], lambda v: list_contains(x, v))), ',') AS present FROM (SELECT lang, list_distinct(list(source_id)) AS x FROM ({DOCS}) GROUP BY 1)")
ROWH = "sha256('document_id=' || document_id || '|content_sha256=' || content_sha256)"
register("h5_content_hash", lambda s, f: L.content_hash(docs(s, f).select("source_id", "document_id", "content_sha256"), ["source_id"]), "source_id content_sha rows:i", f"""WITH r AS (SELECT source_id, {ROWH} AS h FROM ({DOCS}))
         SELECT source_id, sha256(concat_ws('|', {", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR" for i in range(4))}, count(*)::VARCHAR)) AS content_sha, count(*) AS rows FROM r GROUP BY 1""")
register("e38_call_totals", lambda s, f: calls(s, f).groupBy("status").agg(F.count("*").alias("n"), F.max_by("call_id", F.struct("completed_at", "call_id")).alias("latest")), "status n:i latest:i", f"SELECT status, count(*) AS n, arg_max(call_id, (completed_at, call_id)) AS latest FROM ({CALLS}) GROUP BY 1")
register("e39_run_summary", lambda s, f: L.unseen(calls(s, f), calls(s, f).where("run < 3"), ["call_id"]).agg(F.count("*").alias("new_calls"), F.count_if(c("status") == "success").alias("success"), F.count_if(c("status") == "failed").alias("failed")), "new_calls:i success:i failed:i", f"SELECT count(*) AS new_calls, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM ({CALLS}) WHERE run = 3")

# event windows and gates
def decision_rows(s: SparkSession, f: str) -> DataFrame:
    d = labels(pit(bars_4h(s, f), H4), M)
    assets = F.when(c("series_id").isin("click", "view"), "BTC").otherwise("ETH")
    return d.select("series_id", assets.alias("asset"), "ts", "decision_time", "label_available_at", "target_return", "target_positive")


DR = f"SELECT series_id, CASE WHEN series_id IN ('click', 'view') THEN 'BTC' ELSE 'ETH' END AS asset, ts, ts + INTERVAL {H4 + M.latency_s} SECOND AS decision_time, lead(ts, 3) {OS} + INTERVAL {M.latency_s} SECOND AS label_available_at, lead(open, 3) {OS} / lead(open, 2) {OS} - 1 AS target_return FROM ({B4})"


def keyed(s: SparkSession, f: str) -> DataFrame:
    return signals(s, f).where(c("asset").isin("BTC", "ETH"))


def stats_sql(decisions: str, hours: int) -> str:
    """The 14 statistics of each distinct (asset, decision_time)."""
    v = "CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END::DOUBLE"
    w = "source_quality * confidence * greatest(severity, 1e-12)"
    zero = lambda x: f"coalesce({x}, 0)"
    return f"""SELECT k.asset, k.decision_time, count(signal_id) AS event_count,
  count(*) FILTER (v > 0) AS bullish_count, count(*) FILTER (v < 0) AS bearish_count, count(*) FILTER (v = 0) AS neutral_count,
  {zero('avg(v)')} AS direction_balance, {zero('sum(v * w) / nullif(sum(w), 0)')} AS weighted_direction,
  {zero('avg(severity)')} AS severity_mean, {zero('max(severity)')} AS severity_max, {zero('avg(novelty)')} AS novelty_mean, {zero('max(novelty)')} AS novelty_max,
  {zero('avg(confidence)')} AS confidence_mean, {zero('avg(source_quality)')} AS source_quality_mean, count(DISTINCT source_id) AS unique_source_count,
  coalesce(epoch(any_value(k.decision_time)) - epoch(max(available_at)), {hours * 3600}) AS last_event_age_seconds
FROM (SELECT DISTINCT asset, decision_time FROM ({decisions})) k
LEFT JOIN (SELECT *, {v} AS v, {w} AS w FROM ({SIG})) e
  ON e.asset = k.asset AND e.available_at <= k.decision_time AND e.available_at > k.decision_time - INTERVAL {hours} HOUR
GROUP BY k.asset, k.decision_time"""


def win_sql(hours: int) -> str:
    return f"SELECT * FROM ({DR}) d JOIN ({stats_sql(DR, hours)}) g USING (asset, decision_time)"


def windowed(s: SparkSession, f: str, hours: int = 24) -> DataFrame:
    d = decision_rows(s, f)
    g = E.window_features(d.select("asset", "decision_time").distinct(), keyed(s, f), hours, ["asset"])
    return d.join(g, ["asset", "decision_time"])


WSPEC = "series_id ts:t " + " ".join(f"{x}:d" for x in E.STATS)
register("e22_f15_event_windows_24h", windowed, WSPEC, win_sql(24))
register("e22_event_windows_1h", lambda s, f: windowed(s, f, 1), WSPEC, win_sql(1))
register("d10_window_pairs", lambda s, f: E.window_counts(decision_rows(s, f).select("series_id", "asset", "decision_time"), keyed(s, f).select("asset", "available_at"), 6, ["asset"]).where("pairs > 0"), "series_id decision_time:t pairs:i", f"SELECT series_id, decision_time, count(*) AS pairs FROM ({DR}) d JOIN ({SIG}) e ON e.asset = d.asset AND e.available_at <= decision_time AND e.available_at > decision_time - INTERVAL 6 HOUR GROUP BY ALL")
CUT = "2024-01-25 00:00:00"
register("b7_i21_matured_dataset", lambda s, f: E.matured(windowed(s, f), F.lit(CUT).cast("timestamp")), WSPEC + " target_return:d", f"SELECT * FROM ({win_sql(24)}) WHERE decision_time <= TIMESTAMP '{CUT}' AND label_available_at <= TIMESTAMP '{CUT}' AND target_return IS NOT NULL")


NEEDED = {"rows": 300, "dates": 30, "active_rows": 250}


def maturity_of(rows: DataFrame) -> DataFrame:
    """Counts, deficits, failing rules and status of matured rows, per asset."""
    a = rows.groupBy("asset").agg(F.count("*").alias("rows"), F.countDistinct(F.to_date("decision_time")).alias("dates"), F.count_if(c("event_count") > 0).alias("active_rows"), F.sum("target_positive").alias("positives"))
    a = a.withColumns(E.deficits(NEEDED))
    r = E.reasons({n: c(n) >= k for n, k in NEEDED.items()} | {"both_classes": (c("positives") > 0) & (c("positives") < c("rows"))})
    return a.withColumn("r", r).withColumns({"reasons": F.array_join("r", ","), "status": F.when(F.size("r") == 0, "mature").otherwise("immature")})


def matured_at(s: SparkSession, f: str, cut: str) -> DataFrame:
    return E.matured(windowed(s, f), F.lit(cut).cast("timestamp"))


def matured_sql(cut: str) -> str:
    return f"SELECT * FROM ({win_sql(24)}) WHERE decision_time <= TIMESTAMP '{cut}' AND label_available_at <= TIMESTAMP '{cut}' AND target_return IS NOT NULL"


def maturity_sql(cut: str) -> str:
    rules = [f"CASE WHEN {n} < {k} THEN '{n}' END" for n, k in NEEDED.items()] + ["CASE WHEN positives = 0 OR positives = rows THEN 'both_classes' END"]
    return f"""SELECT *, {', '.join(f'greatest({k} - {n}, 0) AS missing_{n}' for n, k in NEEDED.items())},
  array_to_string(list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN reasons = '' THEN 'mature' ELSE 'immature' END AS status
FROM (SELECT asset, count(*) AS rows, count(DISTINCT decision_time::DATE) AS dates, count(*) FILTER (event_count > 0) AS active_rows, sum((target_return > 0)::INT) AS positives
  FROM ({matured_sql(cut)}) GROUP BY 1)"""


register("e23_c21_maturity", lambda s, f: maturity_of(matured_at(s, f, CUT)), "asset rows:i dates:i active_rows:i positives:i missing_rows:i missing_dates:i missing_active_rows:i reasons status", maturity_sql(CUT))


def health(s: SparkSession, f: str) -> DataFrame:
    d = docs(s, f).groupBy("source_id").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("variants"))
    r = signals(s, f).groupBy("source_id").agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set("asset")), ",").alias("assets"))
    k = calls(s, f).groupBy("source_id").agg(F.count_if(c("status") == "success").alias("ok"), F.count_if(c("status") == "failed").alias("failed"))
    j = d.join(r, "source_id", "fullouter").join(k, "source_id", "fullouter")
    return j.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("documents", "variants", "records", "ok", "failed")}).withColumn("healthy", (c("documents") > 0) & (c("failed") * 20 <= c("ok") + c("failed")))


register("d16_e24_source_health", health, "source_id documents:i variants:i records:i assets ok:i failed:i healthy", f"""SELECT *, documents > 0 AND failed * 20 <= ok + failed AS healthy FROM (SELECT source_id, coalesce(documents, 0) AS documents, coalesce(variants, 0) AS variants, coalesce(records, 0) AS records, assets, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed FROM (SELECT source_id, count(*) AS documents, count(DISTINCT lang) AS variants FROM ({DOCS}) GROUP BY 1)
FULL JOIN (SELECT source_id, count(*) AS records, string_agg(DISTINCT asset, ',' ORDER BY asset) AS assets FROM ({SIG}) GROUP BY 1) USING (source_id) FULL JOIN (SELECT source_id, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS failed FROM ({CALLS}) GROUP BY 1) USING (source_id))""")


def call_gate(d: DataFrame) -> DataFrame:
    lat = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000
    g = d.groupBy("run").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.max("attempts").alias("max_attempts"), F.avg(lat).alias("mean_latency"), F.max(lat).alias("max_latency"), F.count_if(c("status") == "failed").alias("failed"), F.countDistinct("source_id").alias("sources"))
    return g.withColumn("reasons", F.array_join(E.reasons({"failed_calls": c("failed") == 0, "token_budget": c("tokens") <= 400_000, "attempts": c("max_attempts") <= 4, "sources": c("sources") >= 2}), ","))


GATE = "run:i calls:i tokens:i max_attempts:i mean_latency:d max_latency:d failed:i sources:i reasons"
GSQL = "SELECT *, array_to_string(list_filter([CASE WHEN failed > 0 THEN 'failed_calls' END, CASE WHEN tokens > 400000 THEN 'token_budget' END, CASE WHEN max_attempts > 4 THEN 'attempts' END, CASE WHEN sources < 2 THEN 'sources' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT run, count(*) AS calls, sum(tokens) AS tokens, max(attempts) AS max_attempts, avg(epoch(completed_at) - epoch(started_at)) AS mean_latency, max(epoch(completed_at) - epoch(started_at)) AS max_latency, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT source_id) AS sources FROM ({}) GROUP BY 1)"
register("e27_call_gate", lambda s, f: call_gate(calls(s, f)), GATE, GSQL.format(CALLS))
register("e28_j9_delta_gate", lambda s, f: call_gate(L.unseen(calls(s, f), calls(s, f).where("run < 3"), ["call_id"])), GATE, GSQL.format(f"SELECT * FROM ({CALLS}) WHERE run = 3"))
register("e29_diversity_gate", lambda s, f: signals(s, f).groupBy("event_type").agg(F.collect_set("source_id").alias("x"), F.collect_set("asset").alias("a")).select("event_type", F.size("x").alias("sources"), F.size("a").alias("assets"), F.size(F.array_except(F.array(*map(F.lit, ("src1", "src9"))), "x")).alias("missing")), "event_type sources:i assets:i missing:i", f"SELECT event_type, count(DISTINCT source_id) AS sources, count(DISTINCT asset) AS assets, 1 + (count(*) FILTER (source_id = 'src1') = 0)::INT AS missing FROM ({SIG}) GROUP BY 1")
SINCE = "2024-01-08 00:00:00"


def state_candidates(s: SparkSession, f: str) -> DataFrame:
    """Stored states: every successful call, with the workflow that made it and whether it has expired."""
    d = calls(s, f).where("status = 'success'")
    return d.withColumns({"workflow": F.element_at(F.array(*map(F.lit, L.WORKFLOWS)), (c("call_id") % len(L.WORKFLOWS) + 1).cast("int")), "expired": c("call_id") % 5 == 0, "created_at": F.date_trunc("hour", "started_at")})


def judged_states(s: SparkSession, f: str) -> DataFrame:
    return L.judge_states(state_candidates(s, f), "source_id", "call_id", F.lit(SINCE).cast("timestamp"))


CANDIDATES = f"SELECT *, {list(L.WORKFLOWS)}[call_id % {len(L.WORKFLOWS)} + 1] AS workflow, call_id % 5 = 0 AS expired, date_trunc('hour', started_at) AS created_at FROM ({CALLS}) WHERE status = 'success'"
JUDGED = f"""SELECT *, CASE WHEN expired THEN 'rejected_expired' WHEN created_at < TIMESTAMP '{SINCE}' THEN 'rejected_too_old'
  WHEN row_number() OVER (PARTITION BY source_id ORDER BY expired, created_at < TIMESTAMP '{SINCE}', created_at DESC, completed_at DESC, list_position({list(L.WORKFLOWS)}, workflow) DESC, run DESC, call_id DESC) = 1 THEN 'selected' ELSE 'rejected_older' END AS decision FROM ({CANDIDATES})"""
register("g2_state_candidates", judged_states, "source_id call_id:i decision", f"SELECT source_id, call_id, decision FROM ({JUDGED})")
register("g2_g3_latest_state", lambda s, f: L.selected_states(judged_states(s, f), "source_id", ["call_id", "completed_at", "workflow", "run"]), "source_id call_id:i completed_at:t workflow run:i considered:i rejected:i expired:i too_old:i",
         f"""SELECT source_id, any_value(call_id) FILTER (decision = 'selected') AS call_id, any_value(completed_at) FILTER (decision = 'selected') AS completed_at,
         any_value(workflow) FILTER (decision = 'selected') AS workflow, any_value(run) FILTER (decision = 'selected') AS run, count(*) AS considered, count(*) FILTER (decision <> 'selected') AS rejected,
         count(*) FILTER (decision = 'rejected_expired') AS expired, count(*) FILTER (decision = 'rejected_too_old') AS too_old FROM ({JUDGED}) GROUP BY 1""")
register("c15_direction_weights", lambda s, f: signals(s, f).withColumns({"v": E.direction_value(c("direction")), "w": E.weight(c("source_quality"), c("confidence"), c("severity"))}), "signal_id:i v:d w:d", f"SELECT signal_id, CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS v, source_quality * confidence * greatest(severity, 1e-12) AS w FROM ({SIG})")
register("b9_asset_filter", lambda s, f: signals(s, f).where(c("asset").isin("BTC", "MARKET") & (c("available_at") <= F.lit(CUT).cast("timestamp"))).groupBy("asset").agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("signal_id")).alias("repeated")), "asset rows:i repeated:i", f"SELECT asset, count(*) AS rows, count(*) - count(DISTINCT signal_id) AS repeated FROM ({SIG}) WHERE asset IN ('BTC', 'MARKET') AND available_at <= TIMESTAMP '{CUT}' GROUP BY 1")
register("b14_record_contract", lambda s, f: Q.violations(signals(s, f).join(docs(s, f).select("document_id", "asset_tags", "retrieved_at"), "document_id"), {"asset_not_tagged": (c("asset") != "MARKET") & ~F.array_contains("asset_tags", c("asset")), "known_before_event": c("available_at") < c("event_time")}, ["asset"]), "asset rule violations:i",
         " UNION ALL ".join(f"SELECT asset, '{n}' AS rule, count(*) FILTER ({e}) AS violations FROM ({SIG}) s JOIN ({DOCS}) d USING (document_id) GROUP BY 1" for n, e in {"asset_not_tagged": "asset <> 'MARKET' AND NOT list_contains(asset_tags, asset)", "known_before_event": "available_at < event_time"}.items()))


def spoiled_signals(s: SparkSession, f: str) -> DataFrame:
    """Signals with some fields broken on purpose."""
    k = c("signal_id")
    return signals(s, f).withColumns({"direction": F.when(k % 53 == 1, F.lit("sideways")).otherwise(c("direction")), "asset": F.when(k % 59 == 2, F.lit(" btc")).otherwise(c("asset")), "severity": F.when(k % 61 == 0, c("severity") + 1.5).otherwise(c("severity")), "event_type": F.when(k % 19 == 0, F.initcap("event_type")).otherwise(c("event_type"))})


SPOILED_SIG = f"SELECT * REPLACE (CASE WHEN signal_id % 53 = 1 THEN 'sideways' ELSE direction END AS direction, CASE WHEN signal_id % 59 = 2 THEN ' btc' ELSE asset END AS asset, CASE WHEN signal_id % 61 = 0 THEN severity + 1.5 ELSE severity END AS severity, CASE WHEN signal_id % 19 = 0 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END AS event_type) FROM ({SIG})"
register("b15_signal_contract", lambda s, f: Q.violations(spoiled_signals(s, f), {"severity_range": ~c("severity").between(0, 1), "direction_name": ~c("direction").isin("bullish", "bearish", "neutral"), "asset_form": c("asset") != F.upper(F.trim("asset")), "novelty_high": c("novelty") > 0.85}, ["direction"]), "direction rule violations:i",
         " UNION ALL ".join(f"SELECT direction, '{n}' AS rule, count(*) FILTER ({e}) AS violations FROM ({SPOILED_SIG}) GROUP BY 1" for n, e in {"severity_range": "severity < 0 OR severity > 1", "direction_name": "direction NOT IN ('bullish', 'bearish', 'neutral')", "asset_form": "asset <> upper(trim(asset))", "novelty_high": "novelty > 0.85"}.items()))
register("b16_b17_call_contract", lambda s, f: Q.violations(calls(s, f), {"ends_early": c("completed_at") < c("started_at"), "success_with_error": (c("status") == "success") & c("error_code").isNotNull(), "failure_without_code": (c("status") == "failed") & c("error_code").isNull()}, ["source_id"]), "source_id rule violations:i",
         " UNION ALL ".join(f"SELECT source_id, '{n}' AS rule, count(*) FILTER ({e}) AS violations FROM ({CALLS}) GROUP BY 1" for n, e in {"ends_early": "completed_at < started_at", "success_with_error": "status = 'success' AND error_code IS NOT NULL", "failure_without_code": "status = 'failed' AND error_code IS NULL"}.items()))
register("c22_c23_records", lambda s, f: spoiled_signals(s, f).join(docs(s, f).select("document_id", "asset_tags", "content_sha256"), "document_id").select("signal_id", F.when((c("asset") == "MARKET") | F.array_contains("asset_tags", c("asset")), c("asset")).otherwise("MARKET").alias("asset"), c("event_type").rlike("^[a-z][a-z0-9_]*$").alias("valid_type"), X.identity(c("extraction_key"), c("content_sha256")).alias("record_key")), "signal_id:i asset valid_type record_key",
         f"SELECT signal_id, CASE WHEN asset = 'MARKET' OR list_contains(asset_tags, asset) THEN asset ELSE 'MARKET' END AS asset, regexp_matches(event_type, '^[a-z][a-z0-9_]*$') AS valid_type, {IDSQL('extraction_key', 'content_sha256')} AS record_key FROM ({SPOILED_SIG}) JOIN ({DOCS}) USING (document_id)")
