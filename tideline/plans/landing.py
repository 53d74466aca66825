"""Landed payloads, forecasts, stores and streams, on payloads that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scratch
from tideline.functions import text as X
from tideline.operators import events as E
from tideline.operators import forecast as C
from tideline.operators import ledger as L
from tideline.operators import quality as Q
from tideline.operators.features import latch, ordered
from tideline.plans import corpus as P
from tideline.plans.market import B4, BD, DAY, H4, M, O, bars_1d, bars_4h, pit, pit_sql, read
from tideline.plans.shape import register
from tideline.sources import landed as S
from tideline.sources import store as T
from tideline.streaming import jobs as J
from tideline.streaming import keyed

c = F.col
UNTIL, NOW = "2024-01-20 00:00:00", "2024-01-19 06:00:00"
ts = lambda x: F.lit(x).cast("timestamp")
BARSPEC = "series_id ts:t open:d high:d low:d close:d volume:d"


def candle_pages(s: SparkSession, f: str) -> DataFrame:
    """Bars as JSON pages, one a day, each day landed twice; the second landing has one more on the volume."""
    b = bars_4h(s, f).withColumn("landed", F.explode(F.array(F.lit(1), F.lit(2))))
    row = F.array(F.unix_millis("ts").cast("double"), "open", "high", "low", "close", c("volume") + c("landed") - 1)
    return b.groupBy("series_id", "landed", F.to_date("ts").alias("day")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload")).select("series_id", "landed", "payload")


register("a3_candle_pages", lambda s, f: S.candles(candle_pages(s, f), H4, ts(UNTIL), ts(NOW)), BARSPEC, f"SELECT * REPLACE (volume + 1 AS volume) FROM ({B4}) WHERE ts <= TIMESTAMP '{UNTIL}' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 4 HOUR")
register("a4_point_in_time_fetch", lambda s, f: S.candles_known(candle_pages(s, f), H4, ts(UNTIL), ts(NOW), M.latency_s), BARSPEC + " available_at:t", f"SELECT * REPLACE (volume + 1 AS volume) FROM ({pit_sql(B4, H4)}) WHERE ts <= TIMESTAMP '{NOW}' - INTERVAL 4 HOUR AND available_at <= TIMESTAMP '{NOW}'")


def rate_pages(s: SparkSession, f: str) -> DataFrame:
    """Rates as JSON pages, one a day, in the order of time and id."""
    e = read(s, f, "events").withColumn("ms", F.unix_millis(c("ts").cast("timestamp")))
    item = F.struct(c("ms").alias("timestamp"), F.when(c("event_id") % 9 != 0, (c("value") / 1000).cast("string")).otherwise("n/a").alias("fundingRate"), F.when(c("event_id") % 4 != 0, c("value")).alias("openInterestValue"), (c("value") * 2).alias("openInterestAmount"))
    return e.groupBy(c("event_type").alias("series_id"), F.to_date("ts").alias("day")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ms", "event_id", item.alias("item")))), lambda x: x["item"])).alias("payload")).select("series_id", F.lit(1).alias("landed"), "payload")


MS = "date_trunc('millisecond', ts)"
register("a5_funding", lambda s, f: S.funding(rate_pages(s, f), 60).groupBy("series_id").agg(F.count("*").alias("rows"), F.sum("funding_rate").alias("total"), F.max("available_at").alias("last")), "series_id rows:i total:d last:t", f"SELECT series_id, count(*) AS rows, sum(rate) AS total, max(ms) + INTERVAL 60 SECOND AS last FROM (SELECT event_type AS series_id, {MS} AS ms, arg_max(value / 1000, event_id) AS rate FROM events WHERE event_id % 9 <> 0 AND value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
register("a6_open_interest", lambda s, f: S.open_interest(rate_pages(s, f), H4, 60).groupBy("series_id").agg(F.count("*").alias("rows"), F.sum("open_interest").alias("total"), F.max("available_at").alias("last")), "series_id rows:i total:d last:t", f"SELECT series_id, count(*) AS rows, sum(oi) AS total, max(ms) + INTERVAL {H4 + 60} SECOND AS last FROM (SELECT series_id, ms, arg_max(oi, event_id) AS oi FROM (SELECT event_type AS series_id, event_id, {MS} AS ms, CASE WHEN event_id % 4 <> 0 THEN value ELSE value * 2 END AS oi FROM events) WHERE oi >= 0 AND ms IS NOT NULL GROUP BY 1, 2) GROUP BY 1")


def csv_lines(s: SparkSession, f: str) -> DataFrame:
    g = read(s, f, "lineitem").groupBy(c("l_returnflag").alias("series_id"), c("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return g.select("series_id", F.lit(1).alias("landed"), F.concat_ws(",", F.date_format("d", "yyyy-MM-dd"), F.when(c("n") % 5 == 0, ".").otherwise(c("q").cast("string"))).alias("line"))


LINES = "SELECT l_returnflag AS series_id, l_shipdate AS event_time, sum(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY ALL"
WIN = ("1996-01-01", "1999-12-31", "1999-06-30")
for name, positive in (("a8_dated_csv", False), ("a9_price_csv", True)):
    register(name, lambda s, f, p=positive: S.dated_csv(csv_lines(s, f), *map(ts, WIN), 86_700, p), "series_id event_time:t available_at:t value:d", f"SELECT *, event_time + INTERVAL 86700 SECOND AS available_at FROM ({LINES}) WHERE n % 5 <> 0 AND event_time BETWEEN TIMESTAMP '{WIN[0]}' AND TIMESTAMP '{WIN[1]}' AND event_time + INTERVAL 86700 SECOND <= TIMESTAMP '{WIN[2]}'{' AND value > 0' if positive else ''}")


def chart_pages(s: SparkSession, f: str) -> DataFrame:
    g = bars_1d(s, f).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds("ts").alias("t"), "close"))).alias("x"))
    quote = F.struct(F.array(F.struct(c("x.close").alias("close"))).alias("quote"))
    return g.select("series_id", F.to_json(F.struct(F.struct(F.array(F.struct(c("x.t").alias("timestamp"), quote.alias("indicators"))).alias("result")).alias("chart"))).alias("payload"))


register("a10_chart_json", lambda s, f: S.chart_json(chart_pages(s, f)), "series_id event_time:t close:d equal", f"SELECT series_id, ts AS event_time, close, true AS equal FROM ({BD})")


def feeds(s: SparkSession, f: str) -> DataFrame:
    """The pages as RSS payloads, forty items each."""
    item = F.concat(F.lit("<item><title><![CDATA[Page "), c("page_id"), F.lit("]]></title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><description>&lt;p&gt;Body "), c("page_id"), F.lit("&lt;/p&gt;</description><pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate></item>"))
    return read(s, f, "pages").groupBy(F.concat(F.lit("feed"), F.floor(c("page_id") / 40)).alias("source_id")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("payload")).withColumn("retrieved_at", ts("2024-01-02 00:00:00"))


register("a11_feed_counts", lambda s, f: S.feed_counts(feeds(s, f), ["example.com", "example.org"], 30, 300), "source_id entries:i truncated:i skipped:i duplicates:i kept:i",
         r"""WITH p AS (SELECT 'feed' || page_id // 40 AS source_id, row_number() OVER (PARTITION BY page_id // 40 ORDER BY page_id::VARCHAR || ']') AS pos,
           regexp_matches(trim(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.'), '^(.*\.)?example\.(com|org)$') AS usable FROM pages)
         SELECT source_id, count(*) AS entries, greatest(count(*) - 30, 0) AS truncated, count(*) FILTER (pos <= 30 AND NOT usable) AS skipped, 0 AS duplicates, count(*) FILTER (pos <= 30 AND usable) AS kept FROM p GROUP BY 1""")

register("a11_feed_items", lambda s, f: S.feed_items(feeds(s, f), ["example.com", "example.org"], 30, 300).select("source_id", "canonical_url", "title", "summary", "published_at"), "source_id canonical_url title summary published_at:t",
         rf"""WITH p AS (SELECT 'feed' || page_id // 40 AS source_id, page_id, canonical, regexp_matches(host, '^(.*\.)?example\.(com|org)$') AS usable,
           row_number() OVER (PARTITION BY page_id // 40 ORDER BY page_id::VARCHAR || ']') AS pos FROM ({P.CU}))
         SELECT source_id, canonical AS canonical_url, 'Page ' || min(page_id) AS title, 'Body ' || min(page_id) AS summary, TIMESTAMP '2024-01-01 10:00:00' AS published_at FROM p WHERE pos <= 30 AND usable AND canonical IS NOT NULL GROUP BY source_id, canonical""")

# forecasts
CTX, HOR, STR = 12, 6, 4


def forecasts(s: SparkSession, f: str, kind=C.mean) -> DataFrame:
    return C.contexts(pit(bars_4h(s, f), H4), "close", CTX, STR, CTX).withColumn("forecast", kind(HOR))


ORI = f"""WITH b AS (SELECT *, row_number() {O} - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, avg(close) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {CTX - 1} PRECEDING AND CURRENT ROW) AS m FROM ({pit_sql(B4, H4)})), o AS (SELECT * FROM b WHERE pos >= {CTX - 1} AND (pos - {CTX - 1}) % {STR} = 0)"""
register("f16_contexts", lambda s, f: forecasts(s, f).select("series_id", "ts", F.size("context").alias("k"), F.aggregate("context", F.lit(0.0), lambda a, x: a + x).alias("total")), "series_id ts:t k:i total:d", f"{ORI} SELECT series_id, ts, {CTX} AS k, m * {CTX} AS total FROM o")
register("i18_zero_forecast", lambda s, f: C.origin_features(forecasts(s, f, C.zero)), "series_id ts:t point_1:d point_sum:d", f"{ORI} SELECT series_id, ts, 0 AS point_1, 0 AS point_sum FROM o")
register("i19_origin_features", lambda s, f: C.origin_features(forecasts(s, f)), "series_id ts:t point_1:d point_last:d point_sum:d q50_1:d q50_sum:d", f"{ORI} SELECT series_id, ts, m AS point_1, m AS point_last, m * {HOR} AS point_sum, m AS q50_1, m * {HOR} AS q50_sum FROM o")


def carried(s: SparkSession, f: str) -> DataFrame:
    return C.aligned_features(pit(bars_4h(s, f), H4), forecasts(s, f), STR, HOR)


CAR = f"{ORI}, k AS (SELECT o.series_id, o.pos + k AS pos, o.ts AS forecast_origin_at, o.available_at AS forecast_origin_available_at, k + 1 AS forecast_step, m AS point_1, m * ({HOR} - k) AS point_sum, k AS forecast_age_bars FROM o, range(0, {min(STR, HOR)}) r(k) WHERE o.pos + k < o.n), car AS (SELECT b.series_id, b.ts, greatest(b.available_at, forecast_origin_available_at) AS available_at, k.* EXCLUDE (series_id, pos) FROM b JOIN k ON k.series_id = b.series_id AND k.pos = b.pos)"
register("i20_aligned_forecasts", carried, "series_id ts:t forecast_origin_at:t forecast_step:i point_1:d point_sum:d forecast_age_bars:i", f"{CAR} SELECT * FROM car")


def mistimed(s: SparkSession, f: str) -> DataFrame:
    """Carried forecasts with clocks and steps broken on purpose, one after the other."""
    n = F.hour("ts") + F.dayofmonth("ts")
    d = carried(s, f).withColumn("forecast_origin_at", F.when(n % 11 == 0, c("ts") + F.expr("INTERVAL 1 DAY")).otherwise(c("forecast_origin_at")))
    d = d.withColumn("forecast_origin_available_at", F.when(n % 13 == 0, c("forecast_origin_at") - F.expr("INTERVAL 1 HOUR")).otherwise(c("forecast_origin_available_at")))
    d = d.withColumn("available_at", F.when(n % 17 == 0, c("forecast_origin_available_at") - F.expr("INTERVAL 1 SECOND")).otherwise(c("available_at")))
    return d.withColumn("forecast_step", F.when(n % 7 == 0, F.lit(0)).otherwise(c("forecast_step")))


MISTIMED = f"""{CAR}, m1 AS (SELECT *, hour(ts) + day(ts) AS nn FROM car),
m2 AS (SELECT * REPLACE (CASE WHEN nn % 11 = 0 THEN ts + INTERVAL 1 DAY ELSE forecast_origin_at END AS forecast_origin_at) FROM m1),
m3 AS (SELECT * REPLACE (CASE WHEN nn % 13 = 0 THEN forecast_origin_at - INTERVAL 1 HOUR ELSE forecast_origin_available_at END AS forecast_origin_available_at) FROM m2),
m4 AS (SELECT * REPLACE (CASE WHEN nn % 17 = 0 THEN forecast_origin_available_at - INTERVAL 1 SECOND ELSE available_at END AS available_at, CASE WHEN nn % 7 = 0 THEN 0 ELSE forecast_step END AS forecast_step) FROM m3)"""
TIMING = {"origin_after_row": "forecast_origin_at > ts", "origin_known_early": "forecast_origin_available_at < forecast_origin_at", "known_before_origin": "available_at < forecast_origin_available_at", "step_range": f"forecast_step NOT BETWEEN 1 AND {HOR}"}
register("b11_forecast_timing", lambda s, f: Q.violations(mistimed(s, f), C.timing_rules(HOR), ["series_id"]), "series_id rule violations:i", f"{MISTIMED} " + " UNION ALL ".join(f"SELECT series_id, '{n}' AS rule, count(*) FILTER ({e}) AS violations FROM m4 GROUP BY 1" for n, e in TIMING.items()))
register("k2_plugin_forecast", lambda s, f: C.origin_features(forecasts(s, f, lambda h: C.plugin(lambda xs, k: [([x[-1]] * k, {"0.5": [x[-1]] * k}) for x in xs], h)(c("context")))), "series_id ts:t point_1:d point_sum:d", f"{ORI} SELECT series_id, ts, close AS point_1, close * {HOR} AS point_sum FROM o")

# stores
def snapshot(s: SparkSession, f: str) -> DataFrame:
    path = scratch.folder(s, "snapshots")
    d = pit(bars_1d(s, f), DAY)
    first = T.write_snapshot(d, path, "ts", "2002-01-01 00:00:00")
    again = T.write_snapshot(d, path, "ts", "2002-01-01 00:00:00")
    back = T.read_snapshot(s, path, "ts")
    return back.groupBy("series_id").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("available_at").alias("last_known")).withColumn("states", F.lit(f"{first},{again}"))


register("a13_a14_snapshot", snapshot, "series_id rows:i first:t last_known:t states", f"SELECT series_id, count(*) AS rows, min(ts) AS first, max(available_at) AS last_known, 'written,unchanged' AS states FROM ({pit_sql(BD, DAY)}) GROUP BY 1")


def csv_round_trip(s: SparkSession, f: str) -> DataFrame:
    path = scratch.folder(s, "csv")
    S.write_bars_csv(bars_1d(s, f), path)
    return S.read_bars_csv(s, path)


register("a1_a2_csv_round_trip", csv_round_trip, BARSPEC, BD)


def ledger_round_trip(s: SparkSession, f: str) -> DataFrame:
    """The documents' ledger written as JSON lines and read again, with links broken and forked on purpose."""
    path = scratch.folder(s, "ledger")
    d = P.ledger(s, f).select("source_id", "document_id", "seq", "sha", "prev_sha")
    older = d.select("source_id", (c("seq") + 1).alias("seq"), c("prev_sha").alias("older"))
    d = d.join(older, ["source_id", "seq"], "left")
    forked = (c("document_id") % 89 == 7) & (c("seq") > 2)
    d.withColumn("prev_sha", F.when(c("document_id") % 97 == 5, F.concat(F.lit("gone"), c("document_id"))).when(forked, c("older")).otherwise(c("prev_sha"))).drop("older").write.json(path)
    return L.chain_report(S.read_ledger(s, path, "source_id string, document_id long, seq long, sha string, prev_sha string"), "source_id")


register("a12_ledger_scan", ledger_round_trip, "source_id rows:i roots:i broken:i disordered:i forks:i", f"""WITH n AS (SELECT source_id, document_id, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at, document_id) AS seq FROM ({P.DOCS})),
         l AS (SELECT *, CASE WHEN document_id % 97 = 5 THEN -document_id - 1 WHEN document_id % 89 = 7 AND seq > 2 THEN seq - 2 WHEN seq > 1 THEN seq - 1 END AS prev FROM n),
         f AS (SELECT source_id, count(*) AS forks FROM (SELECT source_id, prev FROM l WHERE prev IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
         SELECT l.source_id, count(*) AS rows, count(*) FILTER (prev IS NULL) AS roots, count(*) FILTER (prev < 0) AS broken, 0 AS disordered, coalesce(any_value(forks), 0) AS forks FROM l LEFT JOIN f USING (source_id) GROUP BY 1""")

# streams
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def stream_bars(s: SparkSession, f: str) -> DataFrame:
    return J.finish(J.bars(J.source(s, f"{f}/events.parquet"), "4 hours", "1 hour", c("event_type"), c("value") + 1.0), scratch.folder(s, "bars"))


register("j5_stream_bars", stream_bars, BARSPEC, f"SELECT * FROM ({B4}) WHERE ts + INTERVAL 4 HOUR <= {CLOSED}")


def stream_trailing(s: SparkSession, f: str) -> DataFrame:
    e = J.source(s, f"{f}/events.parquet").select(c("event_type").alias("series_id"), c("ts").cast("timestamp").alias("available_at"), c("value").alias("weight"))
    return J.finish(J.trailing_counts(e, "6 hours", "2 hours", "1 hour", ["series_id"]), scratch.folder(s, "trailing"))


register("j6_stream_trailing", stream_trailing, "series_id decision_time:t events:i weight:d", f"SELECT event_type AS series_id, d AS decision_time, count(*) AS events, sum(value) AS weight FROM (SELECT *, to_timestamp((floor(epoch(ts) / 7200) * 7200 + 7200 * unnest([1, 2, 3]))::BIGINT)::TIMESTAMP AS d FROM events) WHERE d <= {CLOSED} GROUP BY ALL")


LATE = "1 hour"


def streamed(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame]:
    """Two streams over the events: a decision (asset, decision_time) for each signup, and the signals of all."""
    asset = F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "MARKET"))), (c("event_id") % 3 + 1).cast("int")).alias("asset")
    decisions = J.source(s, f"{f}/events.parquet").where("event_type = 'signup'").select(asset, c("event_id").alias("decision_id"), c("ts").cast("timestamp").alias("decision_time"))
    return decisions, P.signals(s, f, J.source(s, f"{f}/events.parquet")).select("asset", "signal_id", "direction", "severity", "novelty", "confidence", "source_quality", "source_id", "available_at")


def stream_windows(s: SparkSession, f: str) -> DataFrame:
    return J.finish(J.trailing_statistics(*streamed(s, f), 6 * 3600, LATE, "asset"), scratch.folder(s, "windows"))


def stream_pairs(s: SparkSession, f: str) -> DataFrame:
    decisions, events = streamed(s, f)
    names = "asset", "decision_id", "signal_id"
    return J.spanned(J.finish(J.trailing_spans(decisions, events, 3600, LATE, *names), scratch.folder(s, "pairs")), *names)


DECISIONS = "SELECT event_id AS decision_id, ['BTC', 'ETH', 'MARKET'][event_id % 3 + 1] AS asset, ts AS decision_time FROM events WHERE event_type = 'signup'"
#: The watermark: the slower stream's newest time less the lateness; a window must have ended a window's length before it.
MARK = f"(SELECT least((SELECT max(decision_time) FROM ({DECISIONS})), (SELECT max(available_at) FROM ({P.SIG}))) - INTERVAL 1 HOUR)"
register("j6_stream_statistics", stream_windows, "asset decision_time:t " + " ".join(f"{x}:d" for x in E.STATS), f"SELECT * FROM ({P.stats_sql(DECISIONS, 6)}) WHERE decision_time <= {MARK} - INTERVAL 6 HOUR")
register("j6_stream_pairs", stream_pairs, "decision_id:i signal_id:i decision_time:t available_at:t",
         f"""SELECT decision_id, signal_id, decision_time, available_at FROM ({DECISIONS}) d
         JOIN ({P.SIG}) e ON e.asset = d.asset AND e.available_at <= d.decision_time AND e.available_at > d.decision_time - INTERVAL 1 HOUR""")


def stream_unique(s: SparkSession, f: str) -> DataFrame:
    e = J.source(s, f"{f}/events.parquet").select(F.concat_ws(":", "event_type", "user_id").alias("key"), c("ts").cast("timestamp").alias("at"))
    return J.finish(J.unique(e, "key", "at", "90 days"), scratch.folder(s, "unique"))


register("j1_stream_unique", lambda s, f: stream_unique(s, f).select("key"), "key", "SELECT DISTINCT event_type || ':' || user_id AS key FROM events")


def stream_append(s: SparkSession, f: str) -> DataFrame:
    """The documents appended twice from a stream; the second run adds nothing."""
    out = scratch.folder(s, "append")
    d = J.source(s, f"{f}/documents.parquet").select(F.sha2("text", 256).alias("sha"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    for run in ("first", "second"):
        J.run_appender(d, J.appender(out, ["sha"], ["at"], "at", run=run), f"{out}-state-{run}")
    return keyed.read(s, out).select("sha")


register("j2_stream_append", stream_append, "sha", "SELECT DISTINCT sha256(text) AS sha FROM documents")


def budget_recovered(s: SparkSession, f: str) -> DataFrame:
    """A quarter of all documents a run, oldest first, until nothing waits: each document with the run that took it."""
    out = scratch.folder(s, "recovered")
    n = read(s, f, "documents").count()
    d = J.source(s, f"{f}/documents.parquet").select("doc_id", F.timestamp_seconds(c("doc_id") * 60).alias("at"))
    append = J.appender(out, ["doc_id"], ["at"], "at", budget=max(1, -(-n // 4)))
    J.run_appender(d, append, f"{out}-state")
    J.recover(s, append, out, ["doc_id"], first=1)
    return keyed.read(s, out).select("doc_id", F.split_part("batch", F.lit("-"), F.lit(-1)).cast("long").alias("turn"))


register("j8_budget_recovered", budget_recovered, "doc_id:i turn:i", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // (SELECT ceil(count(*) / 4.0)::BIGINT FROM documents) AS turn FROM documents")


def capture(s: SparkSession, f: str) -> DataFrame:
    """The capture chain as a stream: pages are parsed (canonical link, text), filtered by host and relevance, and appended once per link."""
    out = scratch.folder(s, "capture")
    p = J.source(s, f"{f}/pages.parquet").select("page_id", X.canonical_url(c("url")).alias("link"), X.tagless(c("html")).alias("text"))
    p = p.where(c("link").isNotNull() & X.host_allowed(X.host_of(c("link")), P.DOMS) & X.relevance(c("text"), P.INC, P.EXC)["accepted"])
    d = p.select("link", F.lit("2024-01-01").cast("timestamp").alias("at"))
    J.run_appender(d, J.appender(out, ["link"], ["at"], "at"), f"{out}-state")
    return keyed.read(s, out).select("link")


register("j1_capture_stream", capture, "link", f"""SELECT DISTINCT canonical AS link FROM ({P.CU}) JOIN (SELECT page_id, trim(regexp_replace(lower({P.TAGLESS}), '\\s+', ' ', 'g')) AS t FROM pages) USING (page_id)
  WHERE ({' OR '.join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in P.DOMS)}) AND len(list_filter({P.INC}, lambda w: contains(t, w))) > 0 AND len(list_filter({P.EXC}, lambda w: contains(t, w))) = 0""")


def switched(d: DataFrame) -> DataFrame:
    return d.select(c("event_type").alias("series_id"), c("ts").cast("timestamp").alias("ts"), (c("value") > 150).alias("entry"), (c("value") < 5).alias("exit"))


LATCH = f"SELECT event_type AS series_id, regime, count(*) AS rows FROM (SELECT *, coalesce(last_value(CASE WHEN value < 5 THEN 0 WHEN value > 150 THEN 1 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS regime FROM events) GROUP BY ALL"
register("j7_stream_latch", lambda s, f: J.finish(J.latch(switched(J.source(s, f"{f}/events.parquet")), "series_id", "entry", "exit"), scratch.folder(s, "latch")).groupBy("series_id", "regime").agg(F.count("*").alias("rows")), "series_id regime:d rows:i",
         LATCH)
register("f8_batch_latch", lambda s, f: latch(switched(read(s, f, "events")), "entry", "exit", "regime").groupBy("series_id", "regime").agg(F.count("*").alias("rows")), "series_id regime:d rows:i", LATCH)


def trajectory(s: SparkSession, f: str) -> DataFrame:
    """One summary row a day of what was known then, each later than the one before, chained by hash."""
    d = P.signals(s, f).groupBy(F.to_date("available_at").alias("day")).agg(F.count("*").alias("records"), F.countDistinct("source_id").alias("sources"))
    d = d.withColumns({"ledger": F.lit("trajectory"), "ts": c("day").cast("timestamp"), "day": c("day").cast("string")})
    return L.chain(d, "ledger", ["ts"], F.concat_ws(":", c("day").cast("string"), "records", "sources"), 30 * DAY).withColumn("advances", F.coalesce(c("ts") > F.lag("ts").over(ordered(["ledger"])), F.lit(True)))


register("j10_j11_trajectory", trajectory, "day records:i sources:i seq:i sha advances", f"SELECT day, records, sources, seq, sha256('trajectory|' || seq || '|' || day || ':' || records || ':' || sources) AS sha, true AS advances FROM (SELECT *, row_number() OVER (ORDER BY day) AS seq FROM (SELECT available_at::DATE::VARCHAR AS day, count(*) AS records, count(DISTINCT source_id) AS sources FROM ({P.SIG}) GROUP BY 1))")
register("e34_e35_coverage_gate", lambda s, f: Q.bar_quality(pit(bars_1d(s, f), DAY), DAY, ts("2001-09-01")).select("series_id", (1 - c("missing_ratio")).alias("coverage"), ((c("missing_ratio") <= 0.05) & (c("staleness_s") <= 90 * DAY) & (c("rows") >= 100)).alias("passes")), "series_id coverage:d passes",
         f"SELECT series_id, count(*) / n AS coverage, count(*) / n >= 0.95 AND epoch(TIMESTAMP '2001-09-01') - epoch(max(available_at)) <= {90 * DAY} AND count(*) >= 100 AS passes FROM (SELECT *, ((epoch(max(ts) OVER (PARTITION BY series_id)) - epoch(min(ts) OVER (PARTITION BY series_id))) / {DAY} + 1) AS n FROM ({pit_sql(BD, DAY)})) GROUP BY series_id, n")
register("c11_ascii_hosts", lambda s, f: read(s, f, "pages").select("page_id", X.ascii_host(X.host_of(c("url"))).alias("host")), "page_id:i host", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages")
