"""As-of joins, contracts and quality reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import asof as A
from tideline.operators import bars as B
from tideline.operators import quality as Q
from tideline.plans.market import B4, BD, DAY, H4, bars_1d, bars_4h, pit, pit_sql, read
from tideline.plans.shape import register

P4, PD = pit_sql(B4, H4), pit_sql(BD, DAY)
PRIMARY = "1-URGENT"


def daily_discount(s: SparkSession, f: str) -> DataFrame:
    """One external series: the mean discount of a ship date, known a day and five minutes later."""
    g = read(s, f, "lineitem").groupBy(F.col("l_shipdate").cast("timestamp").alias("event_time")).agg(F.avg("l_discount").alias("discount"))
    return g.withColumn("available_at", B.shifted(F.col("event_time"), DAY + 300))


EXT = f"SELECT l_shipdate AS event_time, avg(l_discount) AS discount, l_shipdate + INTERVAL {DAY + 300} SECOND AS available_at FROM lineitem GROUP BY l_shipdate"


def d1(s: SparkSession, f: str) -> DataFrame:
    left = pit(bars_1d(s, f), DAY).select("series_id", "ts", "available_at", "close")
    return A.asof(left, daily_discount(s, f), ["discount"], 2 * DAY, [])


register("d1_asof_backward", d1, "series_id ts:t close:d discount:d discount__available_at:t",
         f"SELECT l.series_id, l.ts, l.close, CASE WHEN l.available_at - r.available_at <= INTERVAL 2 DAY THEN r.discount END AS discount, CASE WHEN l.available_at - r.available_at <= INTERVAL 2 DAY THEN r.available_at END AS discount__available_at FROM ({PD}) l ASOF LEFT JOIN ({EXT}) r ON l.available_at >= r.available_at")


def split_venues(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame]:
    d = pit(bars_1d(s, f), DAY)
    return d.where(F.col("series_id") == PRIMARY), d.where(F.col("series_id") != PRIMARY)


def d2(s: SparkSession, f: str) -> DataFrame:
    one, rest = split_venues(s, f)
    left = A.on_venues(one.select("ts", "available_at", "close"), rest.select(F.col("series_id").alias("venue")))
    right = rest.select(F.col("series_id").alias("venue"), "available_at", F.col("close").alias("other_close"))
    return A.asof(left, right, ["other_close"], 2 * DAY, ["venue"]).withColumn("spread_bps", A.spread_bps(F.col("close"), F.col("other_close")))


VEN = f"p AS (SELECT * FROM ({PD}) WHERE series_id = '{PRIMARY}'), o AS (SELECT * FROM ({PD}) WHERE series_id <> '{PRIMARY}'), v AS (SELECT DISTINCT series_id AS venue FROM o)"
register("d2_c5_venue_spread", d2, "venue ts:t other_close:d spread_bps:d",
         f"WITH {VEN}, j AS (SELECT v.venue, p.ts, p.close, CASE WHEN p.available_at - o.available_at <= INTERVAL 2 DAY THEN o.close END AS other_close FROM (SELECT * FROM p, v) p JOIN v ON v.venue = p.venue ASOF LEFT JOIN o ON o.series_id = p.venue AND p.available_at >= o.available_at) SELECT *, (close / other_close - 1) * 10000 AS spread_bps FROM j")


def d3(s: SparkSession, f: str) -> DataFrame:
    d = pit(bars_1d(s, f), DAY)
    found = A.first_available(d.select(F.lit("ALL").alias("key"), F.col("series_id").alias("venue"), "available_at", F.col("close").alias("rate")), ["0-NONE", "5-LOW", "2-HIGH"], keys=["key"])
    return A.asof(d.where(F.col("series_id") == PRIMARY).select("ts", "available_at"), found.select("available_at", "rate"), ["rate"], 3 * DAY, [])


register("d3_fallback_order", d3, "ts:t rate:d rate__available_at:t", f"SELECT l.ts, CASE WHEN l.available_at - r.available_at <= INTERVAL 3 DAY THEN r.close END AS rate, CASE WHEN l.available_at - r.available_at <= INTERVAL 3 DAY THEN r.available_at END AS rate__available_at FROM (SELECT * FROM ({PD}) WHERE series_id = '{PRIMARY}') l ASOF LEFT JOIN (SELECT * FROM ({PD}) WHERE series_id = '5-LOW') r ON l.available_at >= r.available_at")


def d4(s: SparkSession, f: str) -> DataFrame:
    d = pit(bars_1d(s, f), DAY).select("series_id", "ts", "available_at", "close")
    leg = lambda venue, name: d.where(F.col("series_id") == venue).select("available_at", F.col("close").alias(name))
    one = d.where(F.col("series_id") == PRIMARY).select("ts", "available_at", "close")
    two = A.asof(one, leg("2-HIGH", "local"), ["local"], 8 * 3600, [])
    three = A.asof(two, leg("5-LOW", "stable"), ["stable"], 8 * 3600, [])
    return three.withColumn("premium", A.premium(F.col("local"), F.col("close"), F.col("stable") / 100_000))


def leg_sql(venue: str) -> str:
    return f"(SELECT * FROM ({PD}) WHERE series_id = '{venue}')"


register("d4_c6_local_premium", d4, "ts:t local:d stable:d premium:d",
         f"WITH a AS (SELECT p.ts, p.available_at, p.close, CASE WHEN p.available_at - l.available_at <= INTERVAL 8 HOUR THEN l.close END AS local FROM {leg_sql(PRIMARY)} p ASOF LEFT JOIN {leg_sql('2-HIGH')} l ON p.available_at >= l.available_at), b AS (SELECT a.*, CASE WHEN a.available_at - s.available_at <= INTERVAL 8 HOUR THEN s.close END AS stable FROM a ASOF LEFT JOIN {leg_sql('5-LOW')} s ON a.available_at >= s.available_at) SELECT *, local / nullif(close * (stable / 100000), 0) - 1 AS premium FROM b")


def d5(s: SparkSession, f: str) -> DataFrame:
    d = bars_1d(s, f)
    mark, index = (d.where(F.col("series_id") == v).select("ts", F.col("close").alias(n)) for v, n in ((PRIMARY, "mark"), ("2-HIGH", "index")))
    return mark.join(index, "ts").withColumn("basis", F.try_divide("mark", "index") - 1)


register("d5_a7_basis", d5, "ts:t mark:d index:d basis:d", f"SELECT m.ts, m.close AS mark, i.close AS index, m.close / i.close - 1 AS basis FROM {leg_sql(PRIMARY)} m JOIN {leg_sql('2-HIGH')} i USING (ts)")
register("d6_venue_pairs", lambda s, f: Q.venue_pairs(bars_1d(s, f)).groupBy("primary", "secondary").agg(F.count("*").alias("rows"), F.sum(F.col("a") - F.col("b")).alias("apart")), "primary secondary rows:i apart:d", f"SELECT a.series_id AS \"primary\", b.series_id AS secondary, count(*) AS rows, sum(a.close - b.close) AS apart FROM ({BD}) a JOIN ({BD}) b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY ALL")


def d7(s: SparkSession, f: str) -> DataFrame:
    left = pit(bars_1d(s, f), DAY).select("series_id", "ts", "available_at", "close")
    cache = daily_discount(s, f).select(F.col("event_time").alias("ts"), "available_at", "discount")
    return A.with_cache(left, cache, ["ts"])


register("d7_cache_clock", d7, "series_id ts:t available_at:t close:d discount:d", f"SELECT l.series_id, l.ts, greatest(l.available_at, coalesce(r.available_at, l.available_at)) AS available_at, l.close, r.discount FROM ({PD}) l LEFT JOIN ({EXT}) r ON r.event_time = l.ts")
register("d15_attach_columns", lambda s, f: bars_4h(s, f).join(read(s, f, "events").groupBy(F.col("event_type").alias("series_id"), F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (H4 * 1_000_000)) * H4).alias("ts")).agg(F.countDistinct("user_id").alias("users")), ["series_id", "ts"], "left"), "series_id ts:t close:d users:i",
         f"SELECT b.series_id, b.ts, b.close, u.users FROM ({B4}) b LEFT JOIN (SELECT event_type, (floor(epoch(ts) / {H4}) * {H4})::BIGINT AS t, count(DISTINCT user_id) AS users FROM events GROUP BY ALL) u ON u.event_type = b.series_id AND u.t = epoch(b.ts)")
register("s3_asof_right_contract", lambda s, f: A.ambiguous(pit(bars_1d(s, f), DAY), ["volume"]), "volume:d available_at:t rows:i", f"SELECT volume, available_at, count(*) AS rows FROM ({PD}) GROUP BY ALL HAVING count(*) > 1")

VIOL = "series_id rule violations:i"


def broken(s: SparkSession, f: str) -> DataFrame:
    """Bars with some broken on purpose, by rule."""
    n = F.hour("ts") + F.dayofmonth("ts")
    return bars_4h(s, f).withColumns({"high": F.when(n % 11 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(n % 13 == 0, -1.0).otherwise(F.col("volume")), "open": F.when(n % 17 == 0, 0.0).otherwise(F.col("open"))})


NN = "(hour(ts) + day(ts))"
BROKEN = f"SELECT series_id, ts, CASE WHEN {NN} % 17 = 0 THEN 0.0 ELSE open END AS open, CASE WHEN {NN} % 11 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN {NN} % 13 = 0 THEN -1.0 ELSE volume END AS volume FROM ({B4})"


def viol_sql(source: str, rules: dict[str, str], keys: str = "series_id") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS rule, count(*) FILTER ({c}) AS violations FROM ({source}) GROUP BY ALL" for n, c in rules.items())


register("b1_ohlcv_contract", lambda s, f: Q.ohlcv_contract(broken(s, f)), VIOL, viol_sql(BROKEN, {
    "not_finite": "open IS NULL OR high IS NULL", "price_not_positive": "least(open, high, low, close) <= 0", "volume_negative": "volume < 0", "high_too_low": "high < greatest(open, close, low)",
    "low_too_high": "low > least(open, close, high)", "timestamp_null": "ts IS NULL", "timestamp_repeated": "false"}))
LAGS = f"SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS t0, lag(available_at) OVER (PARTITION BY series_id ORDER BY ts) AS a0 FROM ({PD})"
register("b2_pit_contract", lambda s, f: Q.pit_contract(pit(bars_1d(s, f), DAY), DAY), VIOL, viol_sql(LAGS, {"open_before_start": "open_available_at < ts", "known_before_open": "available_at < open_available_at", "not_monotonic": "available_at < a0", "irregular": f"epoch(ts) - epoch(t0) <> {DAY}"}))
register("b12_b18_order_contract", lambda s, f: Q.order_contract(pit(bars_1d(s, f), DAY), ["series_id"], "available_at"), VIOL, viol_sql(LAGS, {"null_time": "available_at IS NULL", "repeated": "available_at = a0", "goes_back": "available_at < a0"}))
AS_OF = "2001-09-01 00:00:00"
register("e1_bar_quality", lambda s, f: Q.bar_quality(pit(bars_1d(s, f), DAY), DAY, F.lit(AS_OF).cast("timestamp")), "series_id rows:i expected_rows:i missing:i missing_ratio:d irregular_gaps:i max_gap_s:d zero_volume_ratio:d start:t end:t last_available:t staleness_s:d",
         f"SELECT *, greatest(expected_rows - rows, 0) AS missing, greatest(expected_rows - rows, 0) / expected_rows AS missing_ratio FROM (SELECT series_id, count(*) AS rows, ((epoch(max(ts)) - epoch(min(ts))) / {DAY} + 1)::BIGINT AS expected_rows, count(*) FILTER (epoch(ts) - epoch(t0) <> {DAY}) AS irregular_gaps, coalesce(max(epoch(ts) - epoch(t0)), 0) AS max_gap_s, avg((volume = 0)::INT) AS zero_volume_ratio, min(ts) AS start, max(ts) AS \"end\", max(available_at) AS last_available, epoch(TIMESTAMP '{AS_OF}') - epoch(max(available_at)) AS staleness_s FROM ({LAGS}) GROUP BY 1)")
register("e2_cross_venue", lambda s, f: Q.cross_venue(bars_1d(s, f)), "primary secondary overlap_rows:i overlap_ratio:d correlation:d median_bps:d p95_bps:d max_bps:d",
         f"""WITH b AS ({BD}), n AS (SELECT series_id, count(*) AS n FROM b GROUP BY 1), j AS (SELECT a.series_id AS "primary", b.series_id AS secondary, a.ts, a.close AS x, b.close AS y FROM b a JOIN b ON a.ts = b.ts AND a.series_id < b.series_id),
k AS (SELECT *, ln(x) - ln(lag(x) OVER w) AS rx, ln(y) - ln(lag(y) OVER w) AS ry, abs(x / y - 1) * 10000 AS bps FROM j WINDOW w AS (PARTITION BY "primary", secondary ORDER BY ts))
SELECT "primary", secondary, count(*) AS overlap_rows, count(*) / least(any_value(n1.n), any_value(n2.n)) AS overlap_ratio, corr(rx, ry) AS correlation, quantile_cont(bps, 0.5) AS median_bps, quantile_cont(bps, 0.95) AS p95_bps, max(bps) AS max_bps FROM k JOIN n n1 ON n1.series_id = "primary" JOIN n n2 ON n2.series_id = secondary GROUP BY ALL""")
MISS = ["close", "discount", "available_at"]
register("e3_missingness", lambda s, f: Q.missingness(d7(s, f), MISS), "column null_ratio:d", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(({c} IS NULL)::INT) AS null_ratio FROM (SELECT l.close, r.discount, l.available_at FROM ({PD}) l LEFT JOIN ({EXT}) r ON r.event_time = l.ts)" for c in MISS))
register("d14_missing_bars", lambda s, f: Q.missing_bars(bars_1d(s, f), DAY), "series_id ts:t", f"WITH b AS ({BD}), e AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM b GROUP BY series_id) SELECT e.series_id, e.ts FROM e ANTI JOIN b USING (series_id, ts)")
register("f13_gaps", lambda s, f: Q.gaps(bars_1d(s, f), DAY), "series_id ts:t gap_s:i", f"SELECT series_id, ts, epoch(ts) - epoch(t0) AS gap_s FROM ({LAGS}) WHERE epoch(ts) - epoch(t0) <> {DAY}")


def declared(s: SparkSession, names: list[str]) -> DataFrame:
    return s.createDataFrame([(x,) for x in names], "series_id string")


SOURCES = ["1-URGENT", "5-LOW", "9-ABSENT"]
register("a18_source_outcomes", lambda s, f: Q.outcomes(bars_1d(s, f), declared(s, SOURCES), "series_id", "ts"), "series_id status rows:i first:t last:t",
         f"SELECT d.series_id, CASE WHEN count(b.ts) = 0 THEN 'failed' ELSE 'succeeded' END AS status, count(b.ts) AS rows, min(b.ts) AS first, max(b.ts) AS last FROM (SELECT unnest({SOURCES}) AS series_id) d LEFT JOIN ({BD}) b USING (series_id) GROUP BY 1")
register("c7_utc_times", lambda s, f: read(s, f, "events").select("event_id", F.to_timestamp(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("at")), "event_id:i at:t", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
