"""Rolling features, labels and the long/flat rule of a panel of series.

All windows of a series share one partitioning and one order, so a plan has one exchange
and one sort for them. The exponential average is a scan in chunks: chunks of one series run in
parallel, all averages in one pass, and only chunk ends meet.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.settings import Market

CHUNK = 256


def ordered(keys: list[str] | None = None) -> W.WindowSpec:
    return W.Window.partitionBy(*(keys or ["series_id"])).orderBy("ts")


def rolling(fn, column: str | Column, n: int, last: int = 0, keys: list[str] | None = None) -> Column:
    """``fn`` over n rows up to ``last``; null unless all n values are there."""
    frame = ordered(keys).rowsBetween(last - n + 1, last)
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(column).over(frame) == n, fn(column).over(frame))


def emas(df: DataFrame, column: str, spans: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """Adds recursive exponential averages by name, alpha = 2 / (span + 1), each seeded by the
    first value and null for the first span - 1 rows.

    All averages share one pass: a sum of weighted values inside each chunk, and what chunks carry on, which a window over chunk ends
    gives. It looks back as many chunks as still weigh anything in a double."""
    keys = keys or ["series_id"]
    c = F.col
    place = F.row_number().over(ordered(keys)) - 1
    d = df.withColumn("_tl_n", place).withColumns({"_tl_chunk": F.floor(c("_tl_n") / CHUNK), "_tl_j": (c("_tl_n") % CHUNK).cast("double")})
    within = W.Window.partitionBy(*keys, "_tl_chunk").orderBy("ts").rowsBetween(W.Window.unboundedPreceding, 0)
    keep = {out: 1.0 - 2.0 / (span + 1) for out, span in spans.items() if span > 1}
    weight = lambda r: F.when(c("_tl_n") == 0, 1.0).otherwise(1.0 - r)
    d = d.withColumns({f"_tl_l_{out}": F.pow(F.lit(r), c("_tl_j")) * F.sum(c(column) * weight(r) * F.pow(F.lit(r), -c("_tl_j"))).over(within) for out, r in keep.items()})
    ends = d.groupBy(*keys, "_tl_chunk").agg(*[F.max_by(f"_tl_l_{out}", "_tl_j").alias(f"_tl_e_{out}") for out in keep])

    def carry(out: str, r: float) -> Column:
        back = W.Window.partitionBy(*keys).orderBy("_tl_chunk").rowsBetween(-2 - math.ceil(42 / (CHUNK * -math.log(r))), -1)
        return F.aggregate(F.collect_list(f"_tl_e_{out}").over(back), F.lit(0.0), lambda acc, x: x + r**CHUNK * acc)

    carries = ends.select(*keys, "_tl_chunk", *[carry(out, r).alias(f"_tl_c_{out}") for out, r in keep.items()])
    d = d.join(carries, [*keys, "_tl_chunk"])
    value = lambda out, r: c(f"_tl_l_{out}") + F.pow(F.lit(r), c("_tl_j") + 1) * c(f"_tl_c_{out}")
    d = d.withColumns({out: F.when(c("_tl_n") >= spans[out] - 1, value(out, r)) for out, r in keep.items()} | {out: c(column) for out, span in spans.items() if span <= 1})
    return d.drop("_tl_n", "_tl_chunk", "_tl_j", *[f"_tl_{x}_{out}" for x in "lc" for out in keep])


def ema(df: DataFrame, column: str, span: int, out: str, keys: list[str] | None = None) -> DataFrame:
    """One of :func:`emas`."""
    return emas(df, column, {out: span}, keys)


def returns(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    c, w = F.col("close"), ordered()
    cols = {"simple_return": F.try_divide(c, F.lag("close").over(w)) - 1, "log_return": F.ln(c) - F.ln(F.lag("close").over(w))}
    return df.withColumns(cols | {f"log_return_{n}": F.ln(c / F.lag("close", n).over(w)) for n in windows})


def volatility(df: DataFrame, windows: dict[str, int], periods: int) -> DataFrame:
    return df.withColumns({name: rolling(F.stddev_pop, "log_return", n) * math.sqrt(periods) for name, n in windows.items()})


def true_range(df: DataFrame, n: int) -> DataFrame:
    before = F.lag("close").over(ordered())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("true_range", tr).withColumn("atr", rolling(F.avg, "true_range", n))


def channels(df: DataFrame, entry: int, exit_: int) -> DataFrame:
    """Highest high and lowest low of the rows before the current one."""
    return df.withColumns({"donchian_entry_high": rolling(F.max, "high", entry, -1), "donchian_exit_low": rolling(F.min, "low", exit_, -1)})


def zscore(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    return df.withColumn(out, (F.col(column) - rolling(F.avg, column, n)) / F.nullif(rolling(F.stddev_pop, column, n), F.lit(0.0)))


def shapes(df: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    return df.withColumns({"ema_ratio": F.col("ema_fast") / F.col("ema_slow") - 1, "atr_pct": F.col("atr") / F.col("close"), "bar_range_pct": span / F.col("close"), "close_location": (F.col("close") - F.col("low")) / F.nullif(span, F.lit(0.0))})


def features(df: DataFrame, m: Market = Market()) -> DataFrame:
    """All features of bars (series_id, ts, open, high, low, close, volume)."""
    d = emas(df, "close", {"ema_fast": m.ema_fast, "ema_slow": m.ema_slow})
    d = volatility(returns(d, m.return_windows), {f"realized_vol_{n}": n for n in m.volatility_windows} | {"realized_volatility": m.volatility_window}, m.periods_per_year)
    d = zscore(channels(true_range(d, m.atr_window), m.donchian_entry, m.donchian_exit), "volume", m.volume_window, "volume_zscore")
    return shapes(d)


def labels(df: DataFrame, m: Market = Market()) -> DataFrame:
    """Open-to-open returns from the first open that a decision can reach, and when they are known."""
    w, enter = ordered(), 1 + m.delay_bars
    leave = enter + m.holding_bars
    d = df.withColumns({
        "decision_time": F.col("available_at"), "entry_time": F.lead("ts", enter).over(w), "exit_time": F.lead("ts", leave).over(w),
        "entry_available_at": F.lead("open_available_at", enter).over(w), "label_available_at": F.lead("open_available_at", leave).over(w),
        "target_return": F.lead("open", leave).over(w) / F.lead("open", enter).over(w) - 1,
    })
    return d.withColumn("target_positive", F.when(F.col("target_return").isNotNull(), (F.col("target_return") > m.threshold_bps / 10_000).cast("double")))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all finite and whose label is known some time."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in columns]
    return df.where(functools.reduce(lambda a, b: a & b, finite) & F.col("target_positive").isNotNull() & F.col("label_available_at").isNotNull())


def feature_names(m: Market = Market()) -> list[str]:
    return [*(f"log_return_{n}" for n in m.return_windows), *(f"realized_vol_{n}" for n in m.volatility_windows), "ema_ratio", "atr_pct", "volume_zscore", "bar_range_pct", "close_location"]


def latch(df: DataFrame, entry: str, exit_: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """1 from an entry to the next exit, else 0; a row with both turns the state over."""
    w = ordered(keys).rowsBetween(W.Window.unboundedPreceding, 0)
    e, x = F.coalesce(F.col(entry), F.lit(False)), F.coalesce(F.col(exit_), F.lit(False))
    d = df.withColumn("_tl_set", F.when(e & ~x, 1).when(x & ~e, 0)).withColumn("_tl_flip", F.sum((e & x).cast("int")).over(w))
    since = F.last(F.when(F.col("_tl_set").isNotNull(), F.struct("_tl_set", "_tl_flip")), ignorenulls=True).over(w)
    d = d.withColumn("_tl_since", since)
    state = (F.coalesce(F.col("_tl_since._tl_set"), F.lit(0)) + F.col("_tl_flip") - F.coalesce(F.col("_tl_since._tl_flip"), F.lit(0))) % 2
    return d.withColumn(out, state.cast("double")).drop("_tl_set", "_tl_flip", "_tl_since")


def vol_target(m: Market, volatility_: Column) -> Column:
    """Target over realized volatility, capped; null or under the least exposure gives 0."""
    size = F.least(F.lit(m.target_volatility) / F.nullif(volatility_, F.lit(0.0)), F.lit(m.max_exposure))
    return F.coalesce(F.when(size >= m.min_exposure, size), F.lit(0.0))


def trend_exposure(featured: DataFrame, m: Market = Market()) -> DataFrame:
    c = F.col
    entry = (c("close") > c("donchian_entry_high")) & (c("ema_fast") > c("ema_slow")) & (c("realized_volatility") <= m.max_volatility)
    leave = F.coalesce(c("close") < c("donchian_exit_low"), F.lit(False)) | F.coalesce(c("ema_fast") < c("ema_slow"), F.lit(False))
    d = featured.withColumns({"entry_signal": F.coalesce(entry, F.lit(False)), "exit_signal": leave})
    d = latch(d, "entry_signal", "exit_signal", "trend_regime")
    return d.withColumn("desired_exposure", c("trend_regime") * vol_target(m, c("realized_volatility")))
