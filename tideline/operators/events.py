"""Event windows at decision times, maturity and health gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: The statistics of a window, in their order.
STATS = ["event_count", "bullish_count", "bearish_count", "neutral_count", "direction_balance", "weighted_direction", "severity_mean", "severity_max", "novelty_mean", "novelty_max", "confidence_mean", "source_quality_mean", "unique_source_count", "last_event_age_seconds"]


def direction_value(direction: Column) -> Column:
    return F.when(direction == "bullish", 1.0).when(direction == "bearish", -1.0).otherwise(0.0)


def weight(quality: Column, confidence: Column, severity: Column) -> Column:
    return quality * confidence * F.greatest(severity, F.lit(1e-12))


def window_pairs(decisions: DataFrame, events: DataFrame, hours: int, keys: list[str]) -> DataFrame:
    """Pairs with decision_time - hours < available_at <= decision_time.

    Events go to the bucket of their time and to the next one, so both sides meet on equal
    buckets; the interval is the join's condition."""
    us = hours * 3_600_000_000
    bucket = lambda c: F.floor(F.unix_micros(c) / us)
    e = events.withColumn("_tl_b", F.explode(F.array(bucket(F.col("available_at")), bucket(F.col("available_at")) + 1)))
    d = decisions.withColumn("_tl_b", bucket(F.col("decision_time")))
    gap = F.unix_micros("decision_time") - F.unix_micros("available_at")
    return d.join(e, [*keys, "_tl_b"]).where((gap >= 0) & (gap < us)).drop("_tl_b")


def measures() -> tuple[dict[str, Column], dict[str, Column]]:
    """What is summed and what is maximised over a window's events; a null counts in no sum and no mean."""
    c = F.col
    v, w = direction_value(c("direction")), weight(c("source_quality"), c("confidence"), c("severity"))
    sums = {"n": F.lit(1), "bullish": (v > 0).cast("int"), "bearish": (v < 0).cast("int"), "neutral": (v == 0).cast("int"), "v": v, "vw": v * w, "w": w}
    for x in ("severity", "novelty", "confidence", "source_quality"):
        sums |= {x: c(x), f"n_{x}": c(x).isNotNull().cast("int")}
    return sums, {"severity_max": c("severity"), "novelty_max": c("novelty"), "last": F.unix_micros("available_at")}


def statistics(window: DataFrame, seconds: int) -> DataFrame:
    """The 14 statistics from the sums, maxima and distinct sources of :func:`measures` (columns named _tl_*); an
    empty window has zeros and an age of the whole window."""
    c = lambda x: F.col(f"_tl_{x}")
    mean = lambda x, n: F.try_divide(c(x), c(n))
    found = {
        "event_count": c("n"), "bullish_count": c("bullish"), "bearish_count": c("bearish"), "neutral_count": c("neutral"), "direction_balance": mean("v", "n"), "weighted_direction": mean("vw", "w"),
        "severity_mean": mean("severity", "n_severity"), "severity_max": c("severity_max"), "novelty_mean": mean("novelty", "n_novelty"), "novelty_max": c("novelty_max"),
        "confidence_mean": mean("confidence", "n_confidence"), "source_quality_mean": mean("source_quality", "n_source_quality"), "unique_source_count": c("sources"),
        "last_event_age_seconds": (F.unix_micros("decision_time") - c("last")) / 1_000_000,
    }
    d = window.withColumns({s: F.coalesce(x.cast("double"), F.lit(float(seconds) if s == "last_event_age_seconds" else 0.0)) for s, x in found.items()})
    return d.drop(*[x for x in window.columns if x.startswith("_tl_")])


def source_changes(events: DataFrame, us: int, keys: list[str], source: str) -> DataFrame:
    """(keys, block, t, change) whose running sum in a block is the number of sources seen in the last ``us``.

    A source's first and last event of each block of that length tell when it comes into view and when it leaves: it is
    in view at the block's start if the block before has it, leaves when its last event there is ``us`` old and comes (back) with its first event here."""
    c = F.col
    per = events.where(c(source).isNotNull()).groupBy(*keys, "_tl_block", source).agg(F.min("_tl_t").alias("first"), F.max("_tl_t").alias("last"))
    own = per.select(*keys, source, "_tl_block", "first", F.lit(None).cast("long").alias("before"))
    carried = per.select(*keys, source, (c("_tl_block") + 1).alias("_tl_block"), F.lit(None).cast("long").alias("first"), c("last").alias("before"))
    both = own.unionByName(carried).groupBy(*keys, source, "_tl_block").agg(F.max("first").alias("first"), F.max("before").alias("before"))
    change = lambda when, t, k: F.when(when, F.struct(t.alias("t"), F.lit(k).alias("k")))
    leaves, seen = c("before") + us, c("before").isNotNull()
    apart = F.coalesce(c("first") > leaves, F.lit(True))
    changes = F.array_compact(F.array(change(seen, c("_tl_block") * us, 1), change(seen & apart, leaves, -1), change(c("first").isNotNull() & apart, c("first"), 1)))
    return both.select(*keys, "_tl_block", F.explode(changes).alias("x")).select(*keys, "_tl_block", c("x.t").alias("_tl_t"), c("x.k").alias("_tl_change"))


def sliding(decisions: DataFrame, events: DataFrame, us: int, keys: list[str], sums: dict[str, Column], maxima: dict[str, Column] | None = None, source: str | None = None) -> DataFrame:
    """For each distinct (keys, decision_time) the sums and maxima over the events of the last ``us``, and the number of distinct sources.

    Time is cut into blocks of the window's length, so a window is the end of one block and the beginning of the next.
    Each decision stands in both, at its own time and a window before; running sums and maxima from the left give
    the second part, from the right the first. No decision is joined with an event, nothing is subtracted, and a task holds one block of a key.
    """
    c, maxima = F.col, maxima or {}
    at = F.unix_micros("available_at")
    e = events.where(c("available_at").isNotNull()).withColumns({"_tl_t": at, "_tl_block": F.floor(at / us)})
    d = decisions.where(c("decision_time").isNotNull()).select(*keys, F.unix_micros("decision_time").alias("_tl_d")).distinct()
    begins, ends = 3, 2  # order among rows of equal time: a change of sources, an event, a window's end, a window's beginning
    side = lambda kind, t: d.select(*keys, "_tl_d", F.lit(kind).alias("_tl_kind"), t.alias("_tl_t"), F.floor(t / us).alias("_tl_block"))
    rows = e.select(*keys, "_tl_block", "_tl_t", F.lit(1).alias("_tl_kind"), *[x.alias(f"_tl_{n}") for n, x in (sums | maxima).items()])
    rows = rows.unionByName(side(ends, c("_tl_d")).unionByName(side(begins, c("_tl_d") - us)), allowMissingColumns=True)
    if source:
        rows = rows.unionByName(source_changes(e, us, keys, source).withColumn("_tl_kind", F.lit(0)), allowMissingColumns=True)
    w = W.Window.partitionBy(*keys, "_tl_block")
    left, right = w.orderBy("_tl_t", "_tl_kind"), w.orderBy(c("_tl_t").desc(), c("_tl_kind").desc())
    side_of = lambda f, n: F.when(c("_tl_kind") == ends, f(f"_tl_{n}").over(left.rowsBetween(W.Window.unboundedPreceding, 0))).otherwise(f(f"_tl_{n}").over(right.rowsBetween(W.Window.unboundedPreceding, 0)))
    out = {f"_tl_{n}": side_of(F.sum, n) for n in sums} | {f"_tl_{n}": side_of(F.max, n) for n in maxima}
    if source:
        out["_tl_change"] = F.when(c("_tl_kind") == ends, F.sum("_tl_change").over(left.rowsBetween(W.Window.unboundedPreceding, 0)))
    seen = rows.select(*keys, "_tl_d", "_tl_kind", *[x.alias(n) for n, x in out.items()]).where(c("_tl_kind") >= ends)
    made = [F.sum(f"_tl_{n}").alias(f"_tl_{n}") for n in sums] + [F.max(f"_tl_{n}").alias(f"_tl_{n}") for n in maxima] + ([F.coalesce(F.sum("_tl_change"), F.lit(0)).alias("_tl_sources")] if source else [])
    return seen.groupBy(*keys, "_tl_d").agg(*made).withColumn("decision_time", F.timestamp_micros("_tl_d")).drop("_tl_d")


def window_counts(decisions: DataFrame, events: DataFrame, hours: int, keys: list[str]) -> DataFrame:
    """decisions with ``pairs``, the number of events with decision_time - hours < available_at <= decision_time."""
    found = sliding(decisions, events, hours * 3_600_000_000, keys, {"pairs": F.lit(1)}).select(*keys, "decision_time", F.coalesce("_tl_pairs", F.lit(0)).alias("pairs"))
    return decisions.join(found, [*keys, "decision_time"])


def window_features(decisions: DataFrame, events: DataFrame, hours: int, keys: list[str]) -> DataFrame:
    """decisions (keys, decision_time) with the 14 statistics of the trailing window."""
    sums, maxima = measures()
    found = statistics(sliding(decisions, events, hours * 3_600_000_000, keys, sums, maxima, "source_id"), hours * 3600)
    if set(decisions.columns) == {*keys, "decision_time"}:
        return found  # a row per distinct decision
    d = decisions.join(found, [*keys, "decision_time"], "left")
    return d.withColumns({s: F.coalesce(F.col(s), F.lit(float(hours * 3600) if s == "last_event_age_seconds" else 0.0)) for s in STATS})


def matured(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where((F.col("decision_time") <= as_of) & (F.col("label_available_at") <= as_of) & F.col("target_return").isNotNull() & F.col("target_positive").isNotNull())


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold, in the order in which they stand."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()]))


def deficits(required: dict[str, int]) -> dict[str, Column]:
    return {f"missing_{n}": F.greatest(F.lit(k) - F.col(n), F.lit(0)) for n, k in required.items()}
