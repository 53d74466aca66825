"""Parsers of landed payloads: pages of candles, rates, CSV and JSON series, feeds.

Every parser takes a DataFrame of payload rows, so a whole landing folder is one job; each row's
arrays are exploded on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.operators.bars import add_availability, closed_as_of, keep_last, shifted

BAR = "series_id string, ts timestamp, open double, high double, low double, close double, volume double"


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR).option("header", True).option("mode", "FAILFAST").csv(path)


def write_bars_csv(bars: DataFrame, path: str) -> None:
    bars.select("series_id", "ts", "open", "high", "low", "close", "volume").write.option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a strict schema; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def candles(pages: DataFrame, seconds: int, until: Column, now: Column) -> DataFrame:
    """Bars of pages (series_id, landed, payload: JSON [[ms, o, h, l, c, v], ...]): the last landed row of
    a time wins, and the bar that is still forming goes."""
    rows = pages.select("series_id", "landed", F.posexplode(F.from_json("payload", "array<array<double>>")).alias("i", "x"))
    x = F.col("x")
    bars = rows.select("series_id", F.timestamp_millis(x[0].cast("long")).alias("ts"), *[x[i].alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], "landed", "i")
    kept = keep_last(bars.where(F.col("ts") <= until), ["series_id", "ts"], [F.col("landed"), F.col("i")]).drop("landed", "i")
    return kept.where(F.col("ts") <= shifted(now, -seconds))


def candles_known(pages: DataFrame, seconds: int, until: Column, now: Column, latency_s: int) -> DataFrame:
    return closed_as_of(add_availability(candles(pages, seconds, until, now), seconds, latency_s), now)


def funding(pages: DataFrame, latency_s: int) -> DataFrame:
    """(series_id, event_time, available_at, funding_rate) of JSON lists of {timestamp, fundingRate}; of a time's rates the last one in the latest landed list wins."""
    rows = pages.select("series_id", "landed", F.posexplode(F.from_json("payload", "array<struct<timestamp:bigint,fundingRate:string>>")).alias("i", "x"))
    rows = rows.select("series_id", F.timestamp_millis("x.timestamp").alias("event_time"), F.col("x.fundingRate").try_cast("double").alias("funding_rate"), "landed", "i").where("event_time IS NOT NULL AND funding_rate IS NOT NULL")
    return keep_last(rows, ["series_id", "event_time"], [F.col("landed"), F.col("i")]).drop("landed", "i").withColumn("available_at", shifted(F.col("event_time"), latency_s))


def open_interest(pages: DataFrame, seconds: int, latency_s: int) -> DataFrame:
    """(series_id, event_time, available_at, open_interest) of JSON lists of {timestamp, openInterestValue, openInterestAmount}; one row per time, as in :func:`funding`."""
    rows = pages.select("series_id", "landed", F.posexplode(F.from_json("payload", "array<struct<timestamp:bigint,openInterestValue:double,openInterestAmount:double>>")).alias("i", "x"))
    rows = rows.select("series_id", F.timestamp_millis("x.timestamp").alias("event_time"), F.coalesce("x.openInterestValue", "x.openInterestAmount").alias("open_interest"), "landed", "i").where("event_time IS NOT NULL AND open_interest >= 0")
    return keep_last(rows, ["series_id", "event_time"], [F.col("landed"), F.col("i")]).drop("landed", "i").withColumn("available_at", shifted(F.col("event_time"), seconds + latency_s))


def dated_csv(lines: DataFrame, start: Column, end: Column, as_of: Column, lag_s: int, positive: bool = False) -> DataFrame:
    """(series_id, event_time, available_at, value) of CSV lines (series_id, landed, line: ``date,value``); ``.`` and
    blanks are missing. ``positive`` also drops values at or under 0, as prices need."""
    part = F.split("line", ",")
    rows = lines.select("series_id", "landed", F.try_to_timestamp(F.get(part, F.lit(0)), F.lit("yyyy-MM-dd")).alias("event_time"), F.get(part, F.lit(1)).try_cast("double").alias("value")).where("event_time IS NOT NULL AND value IS NOT NULL")
    rows = rows.where(F.col("event_time").between(start, end)).withColumn("available_at", shifted(F.col("event_time"), lag_s)).where(F.col("available_at") <= as_of)
    rows = rows.where("value > 0") if positive else rows
    return keep_last(rows, ["series_id", "event_time"], [F.col("landed")]).drop("landed")


CHART = "struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>>"


def chart_json(pages: DataFrame) -> DataFrame:
    """(series_id, event_time, close, equal) of nested chart payloads; equal tells whether both lists have one length."""
    r = pages.select("series_id", F.from_json("payload", CHART).alias("p")).select("series_id", F.col("p.chart.result")[0].alias("r"))
    t, x = F.col("r.timestamp"), F.col("r.indicators.quote")[0]["close"]
    rows = r.select("series_id", (F.size(t) == F.size(x)).alias("equal"), F.explode(F.arrays_zip(t.alias("t"), x.alias("x"))).alias("z"))
    return rows.select("series_id", F.timestamp_seconds("z.t").alias("event_time"), F.col("z.x").alias("close"), "equal").where("close IS NOT NULL")


ITEM = "title STRING, link STRING, description STRING, summary STRING, content STRING, encoded STRING, pubDate STRING, published STRING, updated STRING"


def _entries(payloads: DataFrame, domains: list[str], max_items: int, skew_s: int) -> DataFrame:
    """The first ``max_items`` entries of every payload with ``usable``: whether title, link and host will do."""
    parts = F.regexp_extract_all("payload", F.lit(r"(?s)(<(item|entry)\b.*?</\2>)"), F.lit(1))
    rows = payloads.select("source_id", "retrieved_at", F.posexplode(parts).alias("pos", "part")).where(F.col("pos") < max_items)
    x = F.from_xml("part", ITEM, {"ignoreNamespace": "true"})
    rows = rows.withColumn("x", x).withColumn("atom", F.nullif(F.regexp_extract("part", r"<link\b[^>]*\bhref=[\"']([^\"']+)", 1), F.lit("")))
    d = rows.select(
        "source_id", "retrieved_at", "pos", F.substring(X.strip_markup(F.col("x.title")), 1, 500).alias("title"), X.strip_markup(F.coalesce("x.summary", "x.description", "x.content", "x.encoded")).alias("summary"),
        X.canonical_url(F.coalesce("atom", "x.link")).alias("canonical_url"), X.feed_time(F.coalesce("x.published", "x.updated", "x.pubDate"), F.col("retrieved_at"), skew_s).alias("published_at"),
    )
    usable = (F.col("title") != "") & F.col("canonical_url").isNotNull() & X.host_allowed(X.host_of(F.col("canonical_url")), domains)
    return d.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("text", X.document_text(F.col("title"), F.col("summary")))


def feed_items(payloads: DataFrame, domains: list[str], max_items: int, skew_s: int) -> DataFrame:
    """Documents of RSS or Atom payloads (source_id, payload, retrieved_at): markup stripped, links canonical and of
    allowed hosts, times without a zone or from the future null, the first of equal links kept, ``max_items`` a payload."""
    d = _entries(payloads, domains, max_items, skew_s).where("usable")
    first = d.groupBy("source_id", "canonical_url").agg(F.min_by(F.struct("pos", "title", "summary", "published_at", "retrieved_at", "text"), F.struct("retrieved_at", "pos")).alias("b"))
    d = first.select("source_id", "canonical_url", "b.*")
    return d.withColumns({"content_sha256": F.sha2("text", 256), "document_id": X.identity(F.col("source_id"), F.col("canonical_url"), F.col("title"))})


def feed_counts(payloads: DataFrame, domains: list[str], max_items: int, skew_s: int) -> DataFrame:
    """Per payload (source_id, retrieved_at): entries, truncated (beyond ``max_items``), skipped (no title, no valid link or a host
    that isn't allowed), duplicates (entries equal in link, title, time and text to an earlier one) and kept."""
    c = F.col
    n = payloads.select("source_id", "retrieved_at", F.size(F.regexp_extract_all("payload", F.lit(r"(?s)(<(item|entry)\b.*?</\2>)"), F.lit(1))).alias("entries"))
    d = _entries(payloads, domains, max_items, skew_s)
    same = F.struct("canonical_url", "title", "published_at", F.sha2("text", 256))
    g = d.groupBy("source_id", "retrieved_at").agg(F.count_if(~c("usable")).alias("skipped"), F.countDistinct(F.when(c("usable"), same)).alias("kept"), F.count_if("usable").alias("usable"))
    d = n.join(g, ["source_id", "retrieved_at"], "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    return d.select("source_id", "retrieved_at", "entries", F.greatest(c("entries") - max_items, F.lit(0)).alias("truncated"), zero("skipped").alias("skipped"), (zero("usable") - zero("kept")).alias("duplicates"), zero("kept").alias("kept"))
