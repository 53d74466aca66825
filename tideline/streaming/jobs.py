"""Streaming forms of the incremental operators; each has a batch twin."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators import events as E
from tideline.streaming.keyed import KeyedTable, stored_or_none


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a Parquet table's files."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return r.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a stream takes no single file, that only this name matches


def finish(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what has landed so far and reads what it wrote."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def bars(ticks: DataFrame, width: str, lateness: str, series: Column, price: Column) -> DataFrame:
    """Tumbling bars of (ts, ...); a bar appears when the watermark has passed its end."""
    t = ticks.select(F.col("ts").cast("timestamp").alias("t"), series.alias("series_id"), price.alias("p")).withWatermark("t", lateness)
    g = t.groupBy(F.window("t", width), "series_id").agg(F.min_by("p", "t").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "t").alias("close"), F.count("*").cast("double").alias("volume"))
    return g.select("series_id", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def trailing_counts(events: DataFrame, width: str, step: str, lateness: str, keys: list[str]) -> DataFrame:
    """Counts of sliding windows; a window's end is the decision time that it serves."""
    e = events.withWatermark("available_at", lateness)
    return e.groupBy(F.window("available_at", width, step), *keys).agg(F.count("*").alias("events"), F.sum("weight").alias("weight")).select(*keys, F.col("window.end").alias("decision_time"), "events", "weight")


def trailing_pairs(decisions: DataFrame, events: DataFrame, seconds: int, lateness: str, key: str) -> DataFrame:
    """Stream-stream interval join: decisions (key, decision_time, ...) with the events of the trailing window, a row per pair.

    Events go to the bucket of their time and to the next one, so a row meets the stored rows of two windows' time and not all of its key.
    Both sides carry watermarks, so the state holds the events of a window and the lateness, and the decisions that still wait."""
    c, us = F.col, seconds * 1_000_000
    bucket = lambda x: F.floor(F.unix_micros(x) / us)
    d = decisions.withWatermark("decision_time", lateness).withColumn("_tl_b", bucket("decision_time")).alias("d")
    e = events.withWatermark("available_at", lateness).withColumn("_tl_b", F.explode(F.array(bucket("available_at"), bucket("available_at") + 1))).alias("e")
    within = (c("e.available_at") <= c("d.decision_time")) & (c("e.available_at") > c("d.decision_time") - F.expr(f"INTERVAL {seconds} SECONDS"))
    rest = [c(f"e.{x}") for x in events.columns if x not in decisions.columns]
    return d.join(e, (c(f"d.{key}") == c(f"e.{key}")) & (c("d._tl_b") == c("e._tl_b")) & within, "inner").select(*[c(f"d.{x}") for x in decisions.columns], *rest)


#: Windows in a block of time of :func:`trailing_spans`; events that lie together in :func:`spanned`; rows that a block puts out at a time.
BLOCK, PART, SLICE = 12, 8192, 1 << 16


def meeting(asked: np.ndarray, seen: np.ndarray, us: int) -> np.ndarray:
    """The events (time, id) in the order of their time, with their place there, and below them the decisions with the first place and the one after
    the last of what lies in their last ``us``: columns time, id, low, high, asked. Decisions without events and events before and after all windows are left out."""
    seen = seen[np.argsort(seen[:, 0], kind="stable")]
    low, high = np.searchsorted(seen[:, 0], asked[:, 0] - us, "right"), np.searchsorted(seen[:, 0], asked[:, 0], "right")
    met = high > low
    if not met.any():
        return np.zeros((0, 5), "int64")
    first, last = low[met].min(), high[met].max()
    place = np.arange(last - first)
    events = np.column_stack([seen[first:last], place, place + 1, np.zeros_like(place)])
    return np.concatenate([events, np.column_stack([asked[met], low[met] - first, high[met] - first, np.ones(met.sum(), "int64")])])


def trailing_spans(decisions: DataFrame, events: DataFrame, seconds: int, lateness: str, key: str, decision: str, event: str) -> DataFrame:
    """The pairs of :func:`trailing_pairs` in little space, for :func:`spanned` to write out: the events of a block of time in their order, and for each decision where
    its window begins and ends there. ``decision`` and ``event`` name whole numbers that tell the rows apart; a row without key, time or number meets nothing.

    A block is some windows long; an event stands in its own one, a decision also in the one before if its window reaches back there. The state of a block
    is its events that windows may still need and its decisions that still wait for events, as two packed arrays. What comes meets what is there once: new decisions
    meet all events, waiting ones the new events. So a batch's work, state and output grow with its rows and not with their pairs. Rows later than the watermark are
    dropped; for it, times before 1970 count as its first moment and those after 2199 as the end of that year, which are what Spark's clock and pandas can take."""
    c, us = F.col, seconds * 1_000_000
    span = BLOCK * us

    def side(rows: DataFrame, at: str, number: str, blocks: str, asked: int) -> DataFrame:
        rows = rows.where(c(key).isNotNull() & c(at).isNotNull() & c(number).isNotNull())
        clock = F.least(F.greatest(c(at), F.timestamp_millis(F.lit(1))), F.timestamp_seconds(F.lit(7_258_118_400)))
        rows = rows.select(key, clock.alias("_tl_at"), F.unix_micros(at).alias("_tl_t"), c(number).cast("long").alias("_tl_id")).withWatermark("_tl_at", lateness)
        return rows.select("*", F.explode(F.expr(blocks)).alias("_tl_block"), F.lit(asked).cast("long").alias("_tl_asked"))

    e = side(events, "available_at", event, f"array(_tl_t div {span})", 0)
    d = side(decisions, "decision_time", decision, f"array_distinct(array(_tl_t div {span}, (_tl_t - {us - 1}) div {span}))", 1)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed = lambda x: np.frombuffer(x, "int64").reshape(-1, 2)
        old, waiting, run = (packed(state.get[0]), packed(state.get[1]), state.get[2]) if state.exists else (packed(b""), packed(b""), 0)
        came = np.concatenate([np.zeros((0, 3), "int64"), *[b[["_tl_t", "_tl_id", "_tl_asked"]].to_numpy("int64") for b in batches if len(b)]])
        new, asked = came[came[:, 2] == 0, :2], came[came[:, 2] == 1, :2]
        seen = np.concatenate([old, new])
        for found in (meeting(asked, seen, us), meeting(waiting, new, us)):
            for i in range(0, len(found), SLICE):
                yield pd.DataFrame(found[i : i + SLICE], columns=["_tl_t", "_tl_id", "_tl_low", "_tl_high", "_tl_asked"]).assign(**{key: k[0], "_tl_block": k[1], "_tl_run": run})
            run += 1
        mark, until = state.getCurrentWatermarkMs() * 1000 or -(1 << 62), (int(k[1]) + 1) * span + us  # a watermark of 0 is none yet
        if mark < until:  # rows that aren't late may still come
            waiting = np.concatenate([waiting, asked])
            state.update((seen[seen[:, 0] > mark - us].tobytes(), waiting[waiting[:, 0] > mark].tobytes(), run))
            state.setTimeoutTimestamp(max(-(-until // 1000), 1))
        elif state.exists:
            state.remove()

    kind = decisions.schema[key].dataType.simpleString()
    out = f"{key} {kind}, _tl_block long, _tl_run long, _tl_t long, _tl_id long, _tl_low long, _tl_high long, _tl_asked long"
    return e.unionByName(d).groupBy(key, "_tl_block").applyInPandasWithState(step, out, "seen binary, waiting binary, run long", "append", GroupStateTimeout.EventTimeTimeout)


def spanned(spans: DataFrame, key: str, decision: str, event: str) -> DataFrame:
    """The pairs (key, decision, event, decision_time, available_at) that :func:`trailing_spans` has found, a row per pair.

    Events lie in arrays of ``PART`` in the order of their time; a decision is joined with the few that its window touches and takes its places there. No pair is
    compared, and a task holds an array and the pairs of one decision with it."""
    c, group = F.col, [key, "_tl_block", "_tl_run", "_tl_part"]
    seen = spans.where("_tl_asked = 0").withColumn("_tl_part", F.expr(f"_tl_low div {PART}"))
    seen = seen.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_tl_low", "_tl_t", "_tl_id"))).alias("_tl_seen"))
    seen = seen.select(*group, F.transform("_tl_seen", lambda x: x["_tl_t"]).alias("_tl_times"), F.transform("_tl_seen", lambda x: x["_tl_id"]).alias("_tl_ids"))
    asked = spans.where("_tl_asked = 1").withColumn("_tl_part", F.explode(F.expr(f"sequence(_tl_low div {PART}, (_tl_high - 1) div {PART})")))
    begin = c("_tl_part") * PART
    asked = asked.select(*group, "_tl_t", "_tl_id", F.greatest(c("_tl_low") - begin, F.lit(0)).cast("int").alias("_tl_low"), F.least(c("_tl_high") - begin, F.lit(PART)).cast("int").alias("_tl_high"))
    met = asked.join(seen.hint("merge"), group).select("*", F.explode(F.sequence(c("_tl_low"), c("_tl_high") - 1)).alias("_tl_i"))
    return met.select(key, c("_tl_id").alias(decision), F.get("_tl_ids", c("_tl_i")).alias(event), F.timestamp_micros("_tl_t").alias("decision_time"), F.timestamp_micros(F.get("_tl_times", c("_tl_i"))).alias("available_at"))


def slid(block: pd.DataFrame, at: np.ndarray, start: int, us: int, sums: list[str], maxima: list[str]) -> pd.DataFrame:
    """Sums, maxima and distinct sources over the events (_tl_t, _tl_source, ...) of the last ``us`` at each time of ``at``, all of them in the block that begins at ``start``.

    A window is the end of the block before and the beginning of this one, with running values from both sides, as in
    :func:`tideline.operators.events.sliding`. A source is in view from an event until the window has passed it or its next event comes."""
    block = block.sort_values("_tl_t", kind="stable")
    t = block["_tl_t"].to_numpy("int64")
    cut, low, high = (np.searchsorted(t, x, side) for x, side in ((start, "left"), (at - us, "right"), (at, "right")))

    def both(name, running, join, empty):
        x = block[name].to_numpy("float64")
        before = np.append(running(np.where(np.isnan(x), empty, x)[:cut][::-1])[::-1], empty)
        since = np.insert(running(np.where(np.isnan(x), empty, x)[cut:]), 0, empty)
        return join(before[np.minimum(low, cut)], since[high - cut])

    out = {n: both(n, np.cumsum, np.add, 0.0) for n in sums}
    for n in maxima:
        most = both(n, np.maximum.accumulate, np.maximum, -np.inf)
        out[n] = np.where(np.isneginf(most), np.nan, most)
    named = block.loc[block["_tl_source"].notna(), ["_tl_source", "_tl_t"]]
    leaves = np.minimum(named.groupby("_tl_source")["_tl_t"].shift(-1, fill_value=np.iinfo("int64").max), named["_tl_t"] + us)
    out["_tl_sources"] = np.searchsorted(named["_tl_t"].to_numpy(), at, "right") - np.searchsorted(np.sort(leaves.to_numpy("int64")), at, "right")
    return pd.DataFrame(out)


def trailing_statistics(decisions: DataFrame, events: DataFrame, seconds: int, lateness: str, key: str) -> DataFrame:
    """The 14 statistics of :func:`tideline.operators.events.window_features` for each distinct (key, decision_time) of a stream.

    Decisions without events come too. A decision appears once the watermark is a window past it. Time is cut into blocks of the window's length,
    an event goes to its own block and to the next one, and the state of a block is its waiting decisions and the events that windows may still need, so no
    decision is joined with an event. Rows later than the watermark are dropped; a NaN counts as a null."""
    c, us = F.col, seconds * 1_000_000
    sums, maxima = E.measures()
    at = F.unix_micros("available_at")
    e = events.where(c(key).isNotNull() & c("available_at").isNotNull()).withWatermark("available_at", lateness)
    e = e.select(key, c("available_at").alias("_tl_at"), F.explode(F.array(F.floor(at / us), F.floor(at / us) + 1)).alias("_tl_block"), at.alias("_tl_t"), F.lit(False).alias("_tl_asked"), c("source_id").alias("_tl_source"), *[x.cast("double").alias(f"_tl_{n}") for n, x in (sums | maxima).items()])
    d = decisions.where("decision_time IS NOT NULL").withWatermark("decision_time", lateness)
    t = F.unix_micros("decision_time")
    d = d.select(key, c("decision_time").alias("_tl_at"), F.floor(t / us).alias("_tl_block"), t.alias("_tl_t"), F.lit(True).alias("_tl_asked"), F.lit(None).cast("string").alias("_tl_source"), *[F.lit(None).cast("double").alias(f"_tl_{n}") for n in sums | maxima])
    summed, greatest = [f"_tl_{n}" for n in sums], [f"_tl_{n}" for n in maxima]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [pd.read_feather(io.BytesIO(state.get[0]))] if state.exists else []
        rows += [b[["_tl_t", "_tl_asked", "_tl_source", *summed, *greatest]] for b in batches if len(b)]
        rows = pd.concat(rows, ignore_index=True)
        asked = rows["_tl_asked"].to_numpy(bool)
        waiting, seen = np.unique(rows.loc[asked, "_tl_t"].to_numpy("int64")), rows[~asked]
        mark, start = state.getCurrentWatermarkMs() * 1000, int(k[1]) * us
        due, waiting = waiting[waiting <= mark - us], waiting[waiting > mark - us]
        if len(due):
            yield slid(seen, due, start, us, summed, greatest).assign(**{key: k[0], "_tl_d": due})[[key, "_tl_d", *summed, *greatest, "_tl_sources"]]
        if len(waiting) or mark < start + us:  # a decision may still come while its block is open
            first = min(int(waiting[0]) if len(waiting) else mark, mark)
            kept = pd.concat([rows[asked & (rows["_tl_t"] > mark - us)].drop_duplicates("_tl_t"), seen[seen["_tl_t"] > first - us]], ignore_index=True)
            packed = io.BytesIO()
            kept.to_feather(packed)
            state.update((packed.getvalue(),))
            until = int(waiting[0]) + us if len(waiting) else start + us
            state.setTimeoutTimestamp(max(-(-until // 1000) - 1, mark // 1000))
        elif state.exists:
            state.remove()

    kind = decisions.schema[key].dataType.simpleString()
    out = f"{key} {kind}, _tl_d long, " + ", ".join(f"{n} double" for n in summed + greatest) + ", _tl_sources long"
    g = e.unionByName(d).groupBy(key, "_tl_block").applyInPandasWithState(step, out, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return E.statistics(g.withColumn("decision_time", F.timestamp_micros("_tl_d")).select(key, "decision_time", *summed, *greatest, "_tl_sources"), seconds)


def unique(rows: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def appender(path: str, keys: list[str], payload: list[str], at: str, order: Column | None = None, budget: int | None = None, run: str = "main") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose keys aren't stored yet.

    A batch whose new rows contradict each other fails; rows behind the table's newest ``at`` go to
    ``<path>-late``; beyond ``budget`` the rest waits in ``<path>-pending`` and is taken up by later batches, of this run or any
    other (:func:`recover` works it off without new input); what has waited is never late. Every batch
    writes a folder of its own, its manifest last; a batch that has one has been done, so a replay changes nothing. Of what is stored only the files are
    opened whose filters let a key of the batch through (:class:`tideline.streaming.keyed.KeyedTable`).
    ``run`` names the stream's checkpoint, whose batches count from 0."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name, table = f"{run}-{batch_id}", KeyedTable(spark, path, keys, at)
        if table.has(name):
            return
        waiting = None if budget is None else stored_or_none(spark, f"{path}-pending/batch=*")
        rows = batch.withColumn("_tl_waits", F.lit(0))
        if waiting is not None:
            rows = rows.unionByName(waiting.withColumn("_tl_waits", F.lit(1)))
        per = rows.groupBy(*keys).agg(F.max("_tl_waits").alias("_tl_waits"), F.min(F.struct(*payload)).alias("_tl_least"), F.max(F.struct(*payload)).alias("_tl_most"), F.first(F.struct(*batch.columns)).alias("_tl_row"))
        held = per.persist()
        try:
            if held.where(~F.col("_tl_least").eqNullSafe(F.col("_tl_most"))).limit(1).count():
                raise ValueError("one key comes with different payloads")
            fresh, _ = table.unknown(held.select("_tl_waits", "_tl_row.*"))
            if table.head is not None:
                late = (F.col("_tl_waits") == 0) & (F.unix_micros(F.col(at)) < F.lit(table.head))
                fresh.where(late).drop("_tl_waits").write.mode("overwrite").parquet(f"{path}-late/batch={name}")
                fresh = fresh.where(~F.coalesce(late, F.lit(False)))
            fresh = fresh.select(*batch.columns)
            if budget is not None:
                fresh = fresh.orderBy(order if order is not None else F.col(at), *keys)
                taken = fresh.limit(budget)
                fresh.join(taken.select(*keys), keys, "left_anti").write.mode("overwrite").parquet(f"{path}-pending/batch={name}")
                fresh = taken
            table.append(name, fresh)
        finally:
            held.unpersist()

    return append


def run_appender(stream: DataFrame, append: Callable[[DataFrame, int], None], state: str) -> None:
    stream.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def recover(spark: SparkSession, append: Callable[[DataFrame, int], None], path: str, keys: list[str], first: int = 0) -> int:
    """Works off what waits in ``<path>-pending``, a budget at a time, by batches without input that count from ``first``; the number of them."""
    done = 0
    while True:
        waiting = stored_or_none(spark, f"{path}-pending/batch=*")
        stored = KeyedTable(spark, path, keys, keys[0]).rows()
        if waiting is None:
            return done
        left = waiting if stored is None else waiting.join(stored.select(*keys), keys, "left_anti")
        if not left.limit(1).count():
            return done
        append(waiting.limit(0), first + done)
        done += 1


def latched(entry: np.ndarray, exit_: np.ndarray, active: bool) -> np.ndarray:
    """The state after each row, from the state before the first.

    A row maps the state: an entry alone to long, an exit alone to flat, both together to the other one, neither to itself. The state after
    a row is the last fixed one before it, turned over once for each row since that has both."""
    at = np.maximum.accumulate(np.where(entry ^ exit_, np.arange(len(entry)), -1)) if len(entry) else np.zeros(0, int)
    turns = np.cumsum(entry & exit_)
    fixed = at >= 0
    since = turns - np.where(fixed, turns[at], 0)
    return np.where(fixed, entry[at], active) ^ (since % 2 == 1)


def latch(rows: DataFrame, key: str, entry: str, exit_: str) -> DataFrame:
    """The long/flat state of (key, ts, entry, exit) rows carried from batch to batch: key, ts, regime. Null signals count as false."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        after = latched(*(pdf[x].fillna(False).to_numpy(bool) for x in (entry, exit_)), bool(state.get[0]) if state.exists else False)
        if len(after):
            state.update((int(after[-1]),))
        yield pd.DataFrame({key: k[0], "ts": pdf["ts"], "regime": after.astype(float)})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp, regime double", "active int", "append", GroupStateTimeout.NoTimeout)
