"""Market queries: bars, clocks, features, labels, rule strategy, folds and P&L."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import bars as B
from tideline.operators import features as X
from tideline.operators import folds as D
from tideline.operators import pnl as P
from tideline.plans.shape import register
from tideline.settings import Market, Split

M, S = Market(), Split()
H4, H1, DAY = 14_400, 3_600, 86_400


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars_4h(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(read(spark, sf, "events"), H4, "event_type", F.col("value") + 1.0)


def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(read(spark, sf, "events"), H1, F.lit("ALL"), F.col("value") + 1.0)


def bars_1d(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(read(spark, sf, "orders"), DAY, "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey")


def pit(df: DataFrame, seconds: int) -> DataFrame:
    return B.add_availability(df, seconds, M.latency_s)


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return X.features(bars_4h(spark, sf), M)


def scored(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Hourly rows with labels, a volatility and a deterministic probability, of ``bars`` where they are at hand."""
    d = X.volatility(X.returns(pit(bars_1h(spark, sf) if bars is None else bars, H1), ()), {"realized_volatility": 20}, M.periods_per_year)
    d = X.labels(X.zscore(d, "log_return", 20, "z"), M)
    p = 1 / (1 + F.exp(-F.col("z")))
    return D.positions(d.withColumn("p", p).where("p IS NOT NULL AND label_available_at IS NOT NULL AND realized_volatility IS NOT NULL"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id").agg(F.count("*").alias("n"))


def assigned(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    rows = scored(spark, sf, bars)
    return D.purge(rows, D.sealed_folds(counts(rows), S))


def stressed(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of three models under three cost multipliers, with exposures."""
    rows = assigned(spark, sf).where("part = 'test'")
    models = F.array(*[F.struct(F.lit(n).alias("model"), v.alias("exposure")) for n, v in (
        ("flat", F.lit(0.1)), ("momentum", P.probability_exposure(M, F.col("p"), F.lit(0.5), F.col("realized_volatility"))),
        ("trend", P.probability_exposure(M, F.col("p"), F.lit(0.6), F.col("realized_volatility"))))])
    d = rows.select("*", F.inline(models)).withColumn("cost_multiplier", F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))))
    return P.sealed_pnl(d, KEYS, M)


KEYS = ["series_id", "fold", "model", "cost_multiplier"]


def bars_sql(table: str, series: str, price: str, at: str, order: str, seconds: int) -> str:
    return f"SELECT {series} AS series_id, to_timestamp((floor(epoch({at}) / {seconds}) * {seconds})::BIGINT)::TIMESTAMP AS ts, arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, {order}) AS close, count(*)::DOUBLE AS volume FROM {table} GROUP BY ALL"


B4 = bars_sql("events", "event_type", "value + 1.0", "ts", "ts", H4)
B1 = bars_sql("events", "'ALL'", "value + 1.0", "ts", "ts", H1)
BD = bars_sql("orders", "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey", DAY)


def pit_sql(bars: str, seconds: int) -> str:
    return f"SELECT *, ts + INTERVAL {M.latency_s} SECOND AS open_available_at, ts + INTERVAL {seconds + M.latency_s} SECOND AS available_at FROM ({bars})"


def roll_sql(fn: str, col: str, n: int, last: int = 0) -> str:
    frame = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1 - last} PRECEDING AND {f'{-last} PRECEDING' if last else 'CURRENT ROW'})"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {fn}({col}) {frame} END"


O = "OVER (PARTITION BY series_id ORDER BY ts)"
ROOT = f"sqrt({M.periods_per_year})"
FEATURES = f"""
WITH RECURSIVE n AS (SELECT *, row_number() {O} AS rn FROM ({B4})),
e AS (SELECT series_id, rn, close AS f, close AS s FROM n WHERE rn = 1 UNION ALL
  SELECT n.series_id, n.rn, e.f + (n.close - e.f) * 2.0::DOUBLE / {M.ema_fast + 1}, e.s + (n.close - e.s) * 2.0::DOUBLE / {M.ema_slow + 1} FROM e JOIN n ON n.series_id = e.series_id AND n.rn = e.rn + 1),
r AS (SELECT n.*, close / lag(close) {O} - 1 AS simple_return, ln(close) - ln(lag(close) {O}) AS log_return, {', '.join(f'ln(close / lag(close, {k}) {O}) AS log_return_{k}' for k in M.return_windows)},
  greatest(high - low, abs(high - lag(close) {O}), abs(low - lag(close) {O})) AS true_range FROM n),
v AS (SELECT r.*, CASE WHEN r.rn >= {M.ema_fast} THEN e.f END AS ema_fast, CASE WHEN r.rn >= {M.ema_slow} THEN e.s END AS ema_slow FROM r JOIN e ON e.series_id = r.series_id AND e.rn = r.rn),
f AS (SELECT *, {', '.join(f'{roll_sql("stddev_pop", "log_return", k)} * {ROOT} AS realized_vol_{k}' for k in M.volatility_windows)},
  {roll_sql('stddev_pop', 'log_return', M.volatility_window)} * {ROOT} AS realized_volatility, {roll_sql('avg', 'true_range', M.atr_window)} AS atr,
  {roll_sql('max', 'high', M.donchian_entry, -1)} AS donchian_entry_high, {roll_sql('min', 'low', M.donchian_exit, -1)} AS donchian_exit_low,
  (volume - {roll_sql('avg', 'volume', M.volume_window)}) / nullif({roll_sql('stddev_pop', 'volume', M.volume_window)}, 0) AS volume_zscore,
  ema_fast / ema_slow - 1 AS ema_ratio, (high - low) / close AS bar_range_pct, (close - low) / nullif(high - low, 0) AS close_location FROM v),
feat AS (SELECT *, atr / close AS atr_pct FROM f),
g AS (SELECT *, coalesce(close > donchian_entry_high AND ema_fast > ema_slow AND realized_volatility <= {M.max_volatility}, false) AS entry_signal,
  coalesce(close < donchian_exit_low, false) OR coalesce(ema_fast < ema_slow, false) AS exit_signal FROM feat),
l AS (SELECT *, coalesce(last_value(CASE WHEN exit_signal THEN 0 WHEN entry_signal THEN 1 END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::DOUBLE AS trend_regime,
  least({M.target_volatility} / nullif(realized_volatility, 0), {M.max_exposure}) AS size FROM g),
trend AS (SELECT *, trend_regime * CASE WHEN realized_volatility IS NOT NULL AND realized_volatility <> 0 AND size >= {M.min_exposure} THEN size ELSE 0 END AS desired_exposure FROM l),
t1 AS (SELECT *, coalesce(close / lag(close) {O} - 1, 0) AS asset_return, coalesce(lag(desired_exposure) {O}, 0) AS executed_exposure FROM trend),
t2 AS (SELECT *, abs(executed_exposure - coalesce(lag(executed_exposure) {O}, 0)) AS turnover, executed_exposure * asset_return AS gross_return, coalesce(lag(executed_exposure) {O}, 0) AS prev FROM t1),
t3 AS (SELECT *, turnover * {M.one_way} AS trading_cost, gross_return - turnover * {M.one_way} AS net_return FROM t2),
bt AS (SELECT *, {M.initial_cash} * product(1 + net_return) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM t3)
"""
LEADS = f"lead(ts, 2) {O} AS entry_time, lead(ts, 3) {O} AS exit_time, lead(open_available_at, 2) {O} AS entry_available_at, lead(open_available_at, 3) {O} AS label_available_at, lead(open, 3) {O} / lead(open, 2) {O} - 1 AS target_return"


def metrics_sql(source: str, keys: str, exposure: str, before: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, {M.periods_per_year}.0 / observations) - 1 ELSE 0 END AS annualized_return, s * {ROOT} AS annualized_volatility, CASE WHEN s > 0 THEN m / s * {ROOT} ELSE 0 END AS sharpe FROM (
SELECT {keys}, product(1 + net_return) - 1 AS total_return, stddev_pop(net_return) AS s, avg(net_return) AS m, min(dd) AS max_drawdown, arg_max(close, ts) / arg_min(close, ts) - 1 AS buy_hold_return,
avg({exposure}) AS average_exposure, sum(turnover) AS turnover, count(*) FILTER ({exposure} > 0 AND {before} = 0) AS entries, count(*) AS observations
FROM (SELECT *, q / max(q) {w} - 1 AS dd FROM (SELECT *, product(1 + net_return) {w} AS q FROM {source})) GROUP BY {keys})"""


METRICS = "total_return:d annualized_return:d annualized_volatility:d sharpe:d max_drawdown:d buy_hold_return:d average_exposure:d turnover:d entries:i observations:i"
OHLCV = "series_id ts:t open:d high:d low:d close:d volume:d"
FEAT = " ".join(f"{c}:d" for c in X.feature_names(M))

register("j5_bars_4h", bars_4h, OHLCV, B4)
register("j5_bars_1h", bars_1h, OHLCV, B1)
register("j5_bars_1d", bars_1d, OHLCV, BD)
register("c1_timeframes", lambda s, f: read(s, f, "events").select(F.concat((F.col("event_id") % 7).cast("string"), F.element_at(F.array(*map(F.lit, "smhdwx")), (F.col("event_id") % 6 + 1).cast("int"))).alias("tf")).distinct().withColumn("seconds", B.timeframe_seconds(F.col("tf"))), "tf seconds:i",
         "SELECT tf, CASE WHEN regexp_matches(tf, '^[1-9][0-9]*[smhdw]$') THEN regexp_extract(tf, '^[0-9]+')::BIGINT * CASE right(tf, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 604800 END END AS seconds FROM (SELECT DISTINCT (event_id % 7)::VARCHAR || ['s','m','h','d','w','x'][event_id % 6 + 1] AS tf FROM events)")
register("c2_bar_clocks", lambda s, f: pit(bars_4h(s, f), H4), "series_id ts:t open_available_at:t available_at:t", pit_sql(B4, H4))
register("b3_closed_bars", lambda s, f: B.closed_as_of(pit(bars_4h(s, f), H4), F.lit("2024-01-15 00:00:00").cast("timestamp")), "series_id ts:t available_at:t close:d", f"SELECT * FROM ({pit_sql(B4, H4)}) WHERE available_at <= TIMESTAMP '2024-01-15 00:00:00'")
register("b4_known_events", lambda s, f: B.between(pit(bars_4h(s, f), H4).withColumn("event_time", F.col("ts")), *[F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-20", "2024-01-18")]), "series_id ts:t available_at:t",
         f"SELECT * FROM ({pit_sql(B4, H4)}) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND available_at <= TIMESTAMP '2024-01-18'")
register("h2_keep_last", lambda s, f: B.keep_last(read(s, f, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")]), "user_id:i event_type event_id:i value:d",
         "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
register("c3_f1_returns", lambda s, f: X.returns(bars_4h(s, f), M.return_windows), "series_id ts:t simple_return:d log_return:d " + " ".join(f"log_return_{n}:d" for n in M.return_windows), f"{FEATURES} SELECT * FROM r")
register("f2_volatility", featured, "series_id ts:t realized_volatility:d " + " ".join(f"realized_vol_{n}:d" for n in M.volatility_windows), f"{FEATURES} SELECT * FROM feat")
register("f3_ema", lambda s, f: X.emas(bars_4h(s, f), "close", {"ema_fast": M.ema_fast, "ema_slow": M.ema_slow}), "series_id ts:t ema_fast:d ema_slow:d", f"{FEATURES} SELECT * FROM v")
register("f4_atr", lambda s, f: X.true_range(bars_4h(s, f), M.atr_window), "series_id ts:t true_range:d atr:d", f"{FEATURES} SELECT * FROM feat")
register("f5_donchian", lambda s, f: X.channels(bars_4h(s, f), M.donchian_entry, M.donchian_exit), "series_id ts:t donchian_entry_high:d donchian_exit_low:d", f"{FEATURES} SELECT * FROM feat")
register("f6_volume_zscore", lambda s, f: X.zscore(bars_4h(s, f), "volume", M.volume_window, "volume_zscore"), "series_id ts:t volume_zscore:d", f"{FEATURES} SELECT * FROM feat")
register("c4_bar_shapes", featured, "series_id ts:t ema_ratio:d atr_pct:d bar_range_pct:d close_location:d", f"{FEATURES} SELECT * FROM feat")
register("f7_execution_labels", lambda s, f: X.labels(pit(bars_4h(s, f), H4), M), "series_id ts:t available_at:t entry_time:t exit_time:t entry_available_at:t label_available_at:t target_return:d target_positive:d",
         f"SELECT *, CASE WHEN target_return IS NOT NULL THEN (target_return > 0)::DOUBLE END AS target_positive FROM (SELECT *, {LEADS} FROM ({pit_sql(B4, H4)}))")
register("b5_i5_supervised", lambda s, f: X.finite_rows(X.labels(pit(featured(s, f), H4), M), X.feature_names(M)), f"series_id ts:t label_available_at:t target_return:d target_positive:d {FEAT}",
         f"{FEATURES}, p AS (SELECT *, ts + INTERVAL {M.latency_s} SECOND AS open_available_at FROM feat), q AS (SELECT *, {LEADS} FROM p) SELECT *, (target_return > 0)::DOUBLE AS target_positive FROM q WHERE target_return IS NOT NULL AND label_available_at IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL AND isfinite({c})" for c in X.feature_names(M)))
register("f8_i4_trend_exposure", lambda s, f: X.trend_exposure(featured(s, f), M), "series_id ts:t entry_signal exit_signal trend_regime:d desired_exposure:d", f"{FEATURES} SELECT * FROM trend")
register("f9_backtest", lambda s, f: P.backtest(X.trend_exposure(featured(s, f), M), M), "series_id ts:t executed_exposure:d turnover:d net_return:d equity:d", f"{FEATURES} SELECT * FROM bt")


def flagship(s: SparkSession, f: str) -> DataFrame:
    return P.metrics(P.backtest(X.trend_exposure(featured(s, f), M), M), ["series_id"], "executed_exposure", M.periods_per_year)


register("flagship_trend_metrics", flagship, f"series_id {METRICS}", f"{FEATURES} {metrics_sql('bt', 'series_id', 'executed_exposure', 'prev')}")
register("f10_drawdown", lambda s, f: P.backtest(X.trend_exposure(featured(s, f), M), M).withColumn("drawdown", F.col("equity") / F.max("equity").over(P.running(["series_id"])) - 1), "series_id ts:t drawdown:d",
         f"{FEATURES} SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM bt")
register("f11_entries", lambda s, f: P.backtest(X.trend_exposure(featured(s, f), M), M).withColumn("b", F.lag("executed_exposure").over(X.ordered())).groupBy("series_id").agg(P.entries(F.col("executed_exposure"), F.col("b")).alias("entries")), "series_id entries:i", f"{FEATURES} SELECT series_id, count(*) FILTER (executed_exposure > 0 AND prev = 0) AS entries FROM bt GROUP BY 1")

# hourly rows, folds and sealed P&L
SCORED = f"""WITH b AS ({pit_sql(B1, H1)}), r AS (SELECT *, ln(close) - ln(lag(close) {O}) AS log_return, {LEADS} FROM b),
z AS (SELECT *, available_at AS decision_time, {roll_sql('stddev_pop', 'log_return', 20)} * {ROOT} AS realized_volatility, (log_return - {roll_sql('avg', 'log_return', 20)}) / nullif({roll_sql('stddev_pop', 'log_return', 20)}, 0) AS z FROM r),
scored AS (SELECT *, 1 / (1 + exp(-z)) AS p, (target_return > 0)::DOUBLE AS target_positive, row_number() {O} - 1 AS pos FROM z WHERE z IS NOT NULL AND label_available_at IS NOT NULL AND realized_volatility IS NOT NULL),
cnt AS (SELECT series_id, count(*) AS n FROM scored GROUP BY 1), ends AS (SELECT series_id, unnest(range(0, 1000)) AS fold, n FROM cnt),
ends2 AS (SELECT *, {S.train} + fold * {S.step} AS e FROM ends WHERE {S.train} + fold * {S.step} + {S.calibration + S.validation + S.test + 2 * S.embargo} <= n),
folds AS (SELECT series_id, fold, 'train' AS part, 0 AS start, e AS stop FROM ends2 UNION ALL SELECT series_id, fold, 'calibration', e + {S.embargo}, e + {S.embargo + S.calibration} FROM ends2
  UNION ALL SELECT series_id, fold, 'validation', e + {S.embargo + S.calibration}, e + {S.embargo + S.calibration + S.validation} FROM ends2 UNION ALL SELECT series_id, fold, 'test', e + {2 * S.embargo + S.calibration + S.validation}, e + {2 * S.embargo + S.calibration + S.validation + S.test} FROM ends2),
asg AS (SELECT scored.*, fold, part, start FROM scored JOIN folds ON folds.series_id = scored.series_id AND pos >= start AND pos < stop),
nxt AS (SELECT series_id, fold, part, decision_time AS known_by FROM asg WHERE pos = start),
purged AS (SELECT a.* FROM asg a LEFT JOIN nxt ON nxt.series_id = a.series_id AND nxt.fold = a.fold AND nxt.part = CASE a.part WHEN 'train' THEN 'calibration' WHEN 'calibration' THEN 'validation' WHEN 'validation' THEN 'test' END
  WHERE a.part = 'test' OR a.label_available_at <= known_by),
sized AS (SELECT *, CASE WHEN least({M.target_volatility} / nullif(realized_volatility, 0), {M.max_exposure}) >= {M.min_exposure} AND realized_volatility <> 0 THEN least({M.target_volatility} / realized_volatility, {M.max_exposure}) ELSE 0 END AS size FROM purged)"""
K = "series_id, fold, model, cost_multiplier"
OK = f"OVER (PARTITION BY {K} ORDER BY ts)"


def sealed_sql(exposures: str) -> str:
    """CTEs exposed (with model, exposure, cost_multiplier) to pnl and met."""
    w = f"OVER (PARTITION BY {K} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{SCORED}, exposed AS ({exposures}),
x1 AS (SELECT *, lag(exposure) {OK} AS prev, (lead(ts) {OK} IS NULL)::INT AS is_last, {M.one_way} * cost_multiplier AS rate FROM exposed),
x2 AS (SELECT *, abs(exposure - coalesce(prev, 0)) + is_last * exposure AS turnover, target_return - rate * (prev IS NULL)::INT - rate * is_last AS passive_net FROM x1),
x3 AS (SELECT *, turnover * rate AS trading_cost, exposure * target_return - turnover * rate AS net_return FROM x2),
pnl AS (SELECT *, product(1 + net_return) {w} AS equity FROM x3),
met AS (SELECT *, sd * {ROOT} AS annualized_volatility, CASE WHEN sd > 0 THEN mu / sd * {ROOT} ELSE 0 END AS sharpe FROM (SELECT {K}, product(1 + net_return) - 1 AS net_return, product(1 + passive_net) - 1 AS passive_return, product(1 + target_return) - 1 AS passive_gross_return,
  stddev_pop(net_return) AS sd, avg(net_return) AS mu, min(dd) AS max_drawdown, sum(turnover) AS turnover, sum(trading_cost) AS trading_cost, avg(exposure) AS average_exposure, count(*) FILTER (exposure > 0 AND coalesce(prev, 0) = 0) AS entries, count(*) AS rows
  FROM (SELECT *, equity / max(equity) {w} - 1 AS dd FROM pnl) GROUP BY {K}))"""


MODELS = "SELECT sized.*, unnest([1.0::DOUBLE, 1.5, 2.0]) AS cost_multiplier, model, CASE model WHEN 'flat' THEN 0.1 WHEN 'momentum' THEN CASE WHEN p >= 0.5 THEN size ELSE 0 END ELSE CASE WHEN p >= 0.6 THEN size ELSE 0 END END::DOUBLE AS exposure FROM sized, (VALUES ('flat'), ('momentum'), ('trend')) v(model) WHERE part = 'test'"
SEALED = sealed_sql(MODELS)
SMET = "net_return:d passive_return:d passive_gross_return:d annualized_volatility:d sharpe:d max_drawdown:d turnover:d trading_cost:d average_exposure:d entries:i rows:i"
KEY = "series_id fold:i model cost_multiplier:d"

register("i1_sealed_folds", lambda s, f: D.sealed_folds(counts(scored(s, f)), S), "series_id fold:i part start:i stop:i", f"{SCORED} SELECT * FROM folds")
register("i2_expanding_folds", lambda s, f: D.expanding_folds(counts(bars_1d(s, f)), 400, 100, None, 1), "series_id fold:i train_end:i test_start:i test_end:i",
         f"WITH c AS (SELECT series_id, count(*) AS n FROM ({BD}) GROUP BY 1) SELECT series_id, k + 1 AS fold, 400 + 100 * k AS train_end, 401 + 100 * k AS test_start, 501 + 100 * k AS test_end FROM (SELECT *, unnest(range(0, 1000)) AS k FROM c) WHERE 501 + 100 * k <= n")
register("d17_fold_assignment", lambda s, f: D.assign(scored(s, f), D.sealed_folds(counts(scored(s, f)), S)).groupBy("series_id", "fold", "part").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")), "series_id fold:i part rows:i first:t last:t", f'{SCORED} SELECT series_id, fold, part, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM asg GROUP BY ALL')
register("b6_purged_parts", lambda s, f: assigned(s, f).groupBy("series_id", "fold", "part").agg(F.count("*").alias("rows"), F.max("label_available_at").alias("last_known")), "series_id fold:i part rows:i last_known:t", f"{SCORED} SELECT series_id, fold, part, count(*) AS rows, max(label_available_at) AS last_known FROM purged GROUP BY ALL")


def walk_forward(s: SparkSession, f: str) -> DataFrame:
    d = D.positions(P.backtest(X.trend_exposure(featured(s, f), M), M))
    folds = D.expanding_folds(counts(d), 60, 30, None, 1).select("series_id", "fold", F.col("test_start").alias("start"), F.col("test_end").alias("stop"))
    return P.metrics(D.assign(d, folds), ["series_id", "fold"], "executed_exposure", M.periods_per_year)


register("i3_walk_forward", walk_forward, f"series_id fold:i {METRICS}", f"""{FEATURES}, q AS (SELECT *, row_number() {O} - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM bt),
wf AS (SELECT q.*, k + 1 AS fold FROM q, range(0, 100) t(k) WHERE 91 + 30 * k <= n AND pos >= 61 + 30 * k AND pos < 91 + 30 * k),
wp AS (SELECT *, coalesce(lag(executed_exposure) OVER (PARTITION BY series_id, fold ORDER BY ts), 0) AS prev2 FROM wf) {metrics_sql('wp', 'series_id, fold', 'executed_exposure', 'prev2')}""")
register("f12_i6_i8_sealed_pnl", stressed, f"{KEY} ts:t turnover:d trading_cost:d net_return:d equity:d", f"{SEALED} SELECT * FROM pnl")
register("e5_sealed_metrics", lambda s, f: P.sealed_metrics(stressed(s, f), KEYS, M), f"{KEY} {SMET}", f"{SEALED} SELECT * FROM met")
register("c17_i7_probability_exposure", lambda s, f: assigned(s, f).where("part = 'validation'").withColumn("exposure", P.probability_exposure(M, F.col("p"), F.lit(0.55), F.col("realized_volatility"))), "series_id fold:i ts:t p:d exposure:d", f"{SCORED} SELECT *, CASE WHEN p >= 0.55 THEN size ELSE 0 END AS exposure FROM sized WHERE part = 'validation'")


def thresholds(s: SparkSession, f: str) -> DataFrame:
    d = assigned(s, f).where("part = 'validation'").withColumns({"threshold": F.explode(F.array(*map(F.lit, (0.5, 0.55, 0.6, 0.65)))), "cost_multiplier": F.lit(1.0)})
    d = d.withColumn("exposure", P.probability_exposure(M, F.col("p"), F.col("threshold"), F.col("realized_volatility")))
    keys = ["series_id", "fold", "threshold"]
    return P.choose_threshold(P.sealed_metrics(P.sealed_pnl(d, keys, M), keys, M), ["series_id", "fold"], 3, 0.5)


register("g1_choose_threshold", thresholds, "series_id fold:i threshold:d utility:d", sealed_sql("SELECT sized.*, 1.0::DOUBLE AS cost_multiplier, model, CASE WHEN p >= model THEN size ELSE 0 END::DOUBLE AS exposure FROM sized, (VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65)) v(model) WHERE part = 'validation'")
         + ", u AS (SELECT *, net_return - 0.5 * abs(max_drawdown) AS utility FROM met) SELECT series_id, fold, model AS threshold, utility FROM u QUALIFY row_number() OVER (PARTITION BY series_id, fold ORDER BY entries >= 3 DESC, utility DESC, model DESC) = 1")
register("b20_exposure_guards", lambda s, f: stressed(s, f).groupBy("model").agg(F.count_if(F.isnan("exposure") | F.col("exposure").isNull()).alias("bad_exposure"), F.count_if(~F.col("exposure").between(0, M.max_exposure + 1e-12)).alias("over_limit"), F.count_if(F.col("target_return") <= -1).alias("bad_return")), "model bad_exposure:i over_limit:i bad_return:i",
         f"{SEALED} SELECT model, count(*) FILTER (exposure IS NULL) AS bad_exposure, count(*) FILTER (exposure < 0 OR exposure > {M.max_exposure} + 1e-12) AS over_limit, count(*) FILTER (target_return <= -1) AS bad_return FROM pnl GROUP BY 1")
