"""Contracts as violation counts, and quality reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.features import ordered


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """keys, rule, violations: rows for which a rule's condition holds or is unknown."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return g.unpivot(keys, list(rules), "rule", "violations")


def bad_number(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))


def ohlcv_rules() -> dict[str, Column]:
    c = F.col
    prices = ["open", "high", "low", "close"]
    return {
        "not_finite": functools.reduce(lambda a, b: a | b, [bad_number(x) for x in [*prices, "volume"]]), "price_not_positive": F.least(*prices) <= 0,
        "volume_negative": c("volume") < 0, "high_too_low": c("high") < F.greatest("open", "close", "low"), "low_too_high": c("low") > F.least("open", "close", "high"),
        "timestamp_null": c("ts").isNull(), "timestamp_repeated": c("_tl_same") > 1,
    }


def ohlcv_contract(bars: DataFrame) -> DataFrame:
    same = bars.groupBy("series_id", "ts").agg(F.count("*").alias("_tl_same"))
    return violations(bars.join(same, ["series_id", "ts"], "left").withColumn("_tl_same", F.coalesce("_tl_same", F.lit(1))), ohlcv_rules(), ["series_id"])


def pit_contract(bars: DataFrame, seconds: int) -> DataFrame:
    """Both clocks valid and in order, and bars exactly one timeframe apart."""
    w, c = ordered(), F.col
    us = F.unix_micros
    d = bars.withColumns({"_tl_a": F.lag("available_at").over(w), "_tl_t": F.lag("ts").over(w)})
    first = c("_tl_t").isNull()
    return violations(d, {
        "open_before_start": c("open_available_at") < c("ts"), "known_before_open": c("available_at") < c("open_available_at"),
        "not_monotonic": ~first & (c("available_at") < c("_tl_a")), "irregular": ~first & (us(c("ts")) - us(c("_tl_t")) != seconds * 1_000_000),
    }, ["series_id"])


def order_contract(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Times that are null, repeated or go back, per key, in the order of ``ts``."""
    before = F.lag(at).over(ordered(keys))
    d = df.withColumn("_tl_before", before)
    return violations(d, {"null_time": F.col(at).isNull(), "repeated": F.coalesce(F.col(at) == F.col("_tl_before"), F.lit(False)), "goes_back": F.coalesce(F.col(at) < F.col("_tl_before"), F.lit(False))}, keys)


def bar_quality(bars: DataFrame, seconds: int, as_of: Column) -> DataFrame:
    """Coverage, gaps, zero volumes and staleness of each series."""
    w, c = ordered(), F.col
    s = lambda x: F.unix_micros(x) / 1_000_000
    d = bars.withColumn("_tl_gap", s(c("ts")) - s(F.lag("ts").over(w)))
    g = d.groupBy("series_id").agg(
        F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count_if(c("_tl_gap") != seconds).alias("irregular_gaps"),
        F.coalesce(F.max("_tl_gap"), F.lit(0.0)).alias("max_gap_s"), F.avg((c("volume") == 0).cast("double")).alias("zero_volume_ratio"), F.max("available_at").alias("last_available"),
    )
    g = g.withColumn("expected_rows", ((s(c("end")) - s(c("start"))) / seconds + 1).cast("long"))
    return g.withColumns({"missing": F.greatest(c("expected_rows") - c("rows"), F.lit(0)), "staleness_s": s(as_of) - s(c("last_available"))}).withColumn("missing_ratio", c("missing") / c("expected_rows"))


def missing_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """(series_id, ts) of bars that the grid between a series' ends lacks."""
    ends = bars.groupBy("series_id").agg(F.unix_seconds(F.min("ts")).alias("a"), F.unix_seconds(F.max("ts")).alias("b"))
    grid = ends.select("series_id", F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("_tl_s")).select("series_id", F.timestamp_seconds("_tl_s").alias("ts"))
    return grid.join(bars.select("series_id", "ts"), ["series_id", "ts"], "left_anti")


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    d = bars.withColumn("gap_s", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(ordered())))
    return d.where(F.col("gap_s") != seconds).select("series_id", "ts", "gap_s")


def venue_pairs(bars: DataFrame) -> DataFrame:
    """(primary, secondary, ts, a, b): closes of every pair of venues on their common times."""
    l, r = (bars.select(F.col("series_id").alias(n), "ts", F.col("close").alias(v)) for n, v in (("primary", "a"), ("secondary", "b")))
    return l.join(r, "ts").where("primary < secondary")


def cross_venue(bars: DataFrame) -> DataFrame:
    """Overlap, return correlation and absolute spread of every pair of venues."""
    c = F.col
    w = ordered(["primary", "secondary"])
    d = venue_pairs(bars).withColumns({"x": F.ln(c("a")) - F.ln(F.lag("a").over(w)), "y": F.ln(c("b")) - F.ln(F.lag("b").over(w)), "bps": F.abs(c("a") / c("b") - 1) * 10_000})
    g = d.groupBy("primary", "secondary").agg(F.count("*").alias("overlap_rows"), F.corr("x", "y").alias("corr"), F.percentile("bps", F.lit(0.5)).alias("median"), F.percentile("bps", F.lit(0.95)).alias("p95"), F.max("bps").alias("largest"))
    n = bars.groupBy("series_id").agg(F.count("*").alias("n"))
    g = g.join(n.select(F.col("series_id").alias("primary"), F.col("n").alias("n1")), "primary").join(n.select(F.col("series_id").alias("secondary"), F.col("n").alias("n2")), "secondary")
    enough = c("overlap_rows") >= 2
    return g.select("primary", "secondary", "overlap_rows", (c("overlap_rows") / F.least("n1", "n2")).alias("overlap_ratio"), F.when(enough, c("corr")).alias("correlation"), F.when(enough, c("median")).alias("median_bps"), F.when(enough, c("p95")).alias("p95_bps"), F.when(enough, c("largest")).alias("max_bps"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, null_ratio."""
    g = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return g.unpivot([], columns, "column", "null_ratio")


def outcomes(landed: DataFrame, declared: DataFrame, key: str, at: str) -> DataFrame:
    """One row per declared source: what has landed of it, or that nothing has."""
    g = landed.groupBy(key).agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
    return declared.join(g, key, "left").withColumns({"status": F.when(F.col("rows").isNull(), "failed").otherwise("succeeded"), "rows": F.coalesce("rows", F.lit(0))})
