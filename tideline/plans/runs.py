"""Whole runs: caches, datasets, experiment outputs, ablations, plug-ins and scheduled builds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scratch
from tideline.functions import text as X
from tideline.operators import asof as A
from tideline.operators import events as E
from tideline.operators import extraction as Y
from tideline.operators import features as N
from tideline.operators import ledger as L
from tideline.operators import pnl as P
from tideline.operators import prob as R
from tideline.operators import quality as Q
from tideline.plans import corpus, landing, market, panel, research
from tideline.plans.market import BD, DAY, FEATURES, H4, KEYS, M, METRICS, SEALED, bars_1d, bars_4h, metrics_sql, pit, pit_sql, read
from tideline.plans.shape import register
from tideline.sources import commits as K
from tideline.sources import store as W
from tideline.streaming import jobs as J

c = F.col
register("e4_backtest_metrics", market.flagship, f"series_id {METRICS}", f"{FEATURES} {metrics_sql('bt', 'series_id', 'executed_exposure', 'prev')}")


def cached_features(s: SparkSession, f: str) -> DataFrame:
    """Forecast features written with the hash of the bars that they came from, and read back for the same bars."""
    made_from = {"dataset": L.content_hash(bars_4h(s, f)).first()["content_sha"], "model": "mean", "spec": f"{landing.CTX}/{landing.HOR}/{landing.STR}"}
    path = scratch.folder(s, "cache")
    W.write_bound(landing.carried(s, f), path, made_from)
    return W.read_bound(s, path, made_from)


register("a15_forecast_cache", cached_features, "series_id ts:t forecast_step:i point_1:d point_sum:d", f"{landing.CAR} SELECT * FROM car")


def stored_dataset(s: SparkSession, f: str) -> DataFrame:
    path = scratch.folder(s, "dataset")
    d = E.matured(corpus.windowed(s, f), F.lit(corpus.CUT).cast("timestamp")).select("series_id", "ts", "decision_time", "target_return", *E.STATS)
    W.write_bound(d, path, {"as_of": corpus.CUT})
    return W.read_bound(s, path, {"as_of": corpus.CUT}, corpus.CUT, "decision_time").groupBy("series_id").agg(F.count("*").alias("rows"), F.sum("event_count").alias("events"))


register("a16_dataset_store", stored_dataset, "series_id rows:i events:i", f"SELECT series_id, count(*) AS rows, sum(event_count) AS events FROM ({corpus.win_sql(24)}) WHERE decision_time <= TIMESTAMP '{corpus.CUT}' AND label_available_at <= TIMESTAMP '{corpus.CUT}' AND target_return IS NOT NULL GROUP BY 1")


def experiment(s: SparkSession, f: str) -> DataFrame:
    """The four tables of an experiment, written partitioned by model and read back: rows of each."""
    path = scratch.folder(s, "experiment")
    met = P.sealed_metrics(market.stressed(s, f), KEYS, M)
    tables = {"metrics": met.where("cost_multiplier = 1.0"), "predictions": research.predictions(s, f).select("series_id", "fold", "model", "ts", "net_return"), "summary": met.where("cost_multiplier = 1.0").groupBy("model").agg(F.avg("net_return").alias("net_return")), "stress": met}
    for name, df in tables.items():
        df.write.partitionBy("model").parquet(f"{path}/{name}")
    parts = [s.read.parquet(f"{path}/{n}").groupBy("model").agg(F.count("*").alias("rows")).withColumn("output", F.lit(n)) for n in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


register("a17_experiment_outputs", experiment, "output model rows:i", f"{SEALED}, o AS (SELECT 'metrics' AS output, model, count(*) AS rows FROM met WHERE cost_multiplier = 1.0 GROUP BY ALL UNION ALL SELECT 'predictions', model, count(*) FROM pnl WHERE cost_multiplier = 1.0 GROUP BY ALL UNION ALL SELECT DISTINCT 'summary', model, 1 FROM met UNION ALL SELECT 'stress', model, count(*) FROM met GROUP BY ALL) SELECT * FROM o")


def experiment_ids(s: SparkSession, f: str) -> DataFrame:
    data = L.content_hash(bars_4h(s, f), ["series_id"])
    models = F.explode(F.array(F.lit("prior"), F.lit("ridge_logistic")))
    split = F.lit(str(market.S))
    return data.select("series_id", "content_sha", models.alias("model")).select("series_id", "model", X.identity(c("content_sha"), c("model"), F.lit(",".join(N.feature_names(M))), split, F.lit(str(M))).alias("experiment_id"))


register("c24_experiment_identity", experiment_ids, "series_id model experiment_id")


def trees(s: SparkSession, f: str) -> DataFrame:
    """Boosted trees for every (series, fold), fitted on its train part and scored on its test part."""
    rows = market.assigned(s, f).withColumn("y", c("target_positive"))
    return R.boosted_trees(rows, ["series_id", "fold"], COLS).where("part = 'test'")


COLS = ["log_return", "realized_volatility", "z"]
register("i11_boosted_trees", trees, "series_id fold:i ts:t y:d p:d")


def ablations(s: SparkSession, f: str) -> DataFrame:
    """The sealed protocol for every (series, fold, ablation) of I15's plan at once: columns outside an ablation's set are constant."""
    sets = research.plan_sets()
    columns = sets["all"]
    masks = F.array(*[F.struct(F.lit(n).alias("ablation"), *[F.lit(x in keep).alias(f"has_{x}") for x in columns]) for n, keep in sets.items()])
    bars = scratch.table(market.bars_1h(s, f), "bars")
    features = N.features(bars, M).select("series_id", "ts", *[c(x).alias(f"x_{x}") for x in columns])
    rows = market.assigned(s, f, bars).join(features, ["series_id", "ts"], "left").select("*", F.inline(masks))
    rows = rows.withColumns({f"x_{x}": F.when(c(f"has_{x}"), c(f"x_{x}")).otherwise(0.0) for x in columns})
    return research.sealed_table(bars, scratch.table(rows, "ablations"), ["ablation"], [f"x_{x}" for x in columns], ("prior", "ridge_logistic"))


register("i16_ablation_run", ablations, f"series_id fold:i ablation model {research.RUN}")


def ablation_report(s: SparkSession, f: str) -> DataFrame:
    d = ablations(s, f).where("cost_multiplier = 1.0").groupBy("ablation", "model")
    g = d.agg(F.count("*").alias("folds"), F.avg("net_return").alias("mean_net"), F.median("net_return").alias("median_net"), F.avg((c("net_return") > 0).cast("double")).alias("positive_rate"), F.avg("sharpe").alias("mean_sharpe"), F.min("max_drawdown").alias("worst_drawdown"), F.avg("brier").alias("mean_brier"))
    return g.orderBy(c("mean_net").desc(), c("mean_sharpe").desc())


register("e8_i16_ablation_report", ablation_report, "ablation model folds:i mean_net:d median_net:d positive_rate:d mean_sharpe:d worst_drawdown:d mean_brier:d")


def prepared(s: SparkSession, f: str) -> DataFrame:
    """Supervised rows with features, rule exposure, labels and a cached external feature that moves the clock."""
    d = N.labels(N.trend_exposure(N.features(pit(bars_4h(s, f), H4), M), M), M)
    cache = landing.carried(s, f).select("series_id", "ts", "available_at", c("point_1").alias("forecast_1"))
    return N.finite_rows(A.with_cache(d, cache, ["series_id", "ts"]), [*N.feature_names(M), "forecast_1"])


register("i17_prepared_rows", prepared, "series_id ts:t available_at:t desired_exposure:d forecast_1:d target_return:d", f"""{FEATURES}, p AS (SELECT feat.*, trend.desired_exposure, feat.ts + INTERVAL {M.latency_s} SECOND AS open_available_at FROM feat JOIN trend USING (series_id, ts)),
  q AS (SELECT *, {market.LEADS} FROM p)
  SELECT q.series_id, q.ts, greatest(known.available_at, k.available_at) AS available_at, desired_exposure, k.point_1 AS forecast_1, target_return
  FROM q JOIN ({pit_sql(market.B4, H4)}) known ON known.series_id = q.series_id AND known.ts = q.ts JOIN ({landing.CAR} SELECT * FROM car) k ON k.series_id = q.series_id AND k.ts = q.ts
  WHERE {' AND '.join(f'q.{x} IS NOT NULL AND isfinite(q.{x})' for x in N.feature_names(M))} AND k.point_1 IS NOT NULL AND target_return IS NOT NULL""")


def last_value_model(x: np.ndarray, y: np.ndarray):
    """The simplest plug-in: the train mean, moved by the sign of the first feature."""
    m = y.mean() if len(y) else 0.5
    return lambda z: m + 0.01 * np.sign(np.nan_to_num(z[:, 0]))


register("k1_model_plugin", lambda s, f: R.fit_groups(market.assigned(s, f).withColumn("y", c("target_positive")), ["series_id", "fold"], COLS, last_value_model).where("part = 'test'"), "series_id fold:i ts:t y:d p:d", f"{market.SCORED}, m AS (SELECT series_id, fold, avg(target_positive) AS m FROM purged WHERE part = 'train' GROUP BY ALL) SELECT p.series_id, p.fold, ts, target_positive AS y, m + 0.01 * sign(log_return) AS p FROM purged p JOIN m ON m.series_id = p.series_id AND m.fold = p.fold WHERE part = 'test'")


def scripted_extractor(prompt: str, texts: pd.Series) -> pd.Series:
    """A stand-in for a language model: replies by the text's length, among them broken ones."""

    def reply(text: str) -> str:
        n = len(text)
        if n % 11 == 0:
            return '{"asset": "BTC", "direc'
        if n % 13 == 0:
            return '{"asset": "BTC", "severity": 0.5, "novelty": 0.1, "confidence": 0.9}'
        if n % 17 == 0:
            return '{"asset": "BTC", "direction": "neutral", "severity": "high", "novelty": 0.1, "confidence": 0.9}'
        direction = "sideways" if n % 19 == 0 else "bullish" if n % 3 == 0 else "neutral"
        asset = "eth" if n % 7 == 0 else "BTC" if n % 2 == 0 else "ETH"
        return f'{{"asset": "{asset}", "direction": "{direction}", "severity": {n / 10000}, "novelty": 0.5, "confidence": {0.25 if prompt else 2.0}}}'

    return texts.map(reply)


def replies(s: SparkSession, f: str) -> DataFrame:
    return Y.extracted(corpus.docs(s, f).select("document_id", "text"), "text", scripted_extractor, "Name the asset and the direction.")


REPLIES = """SELECT *, CASE WHEN n % 11 = 0 OR (n % 13 <> 0 AND n % 17 = 0) THEN 'malformed' WHEN n % 13 = 0 THEN 'missing_field' ELSE
  array_to_string(list_filter([CASE WHEN n % 7 = 0 THEN 'asset_form' END, CASE WHEN n % 19 = 0 THEN 'direction_name' END, CASE WHEN n / 10000 > 1 THEN 'severity_range' END], lambda x: x IS NOT NULL), ',') END AS problems,
  CASE WHEN n % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset, CASE WHEN n % 3 = 0 THEN 'bullish' ELSE 'neutral' END AS direction, n / 10000 AS severity
FROM (SELECT doc_id AS document_id, length(coalesce(text, '')) AS n FROM documents)"""
register("k3_extractor_plugin", lambda s, f: Y.accepted(replies(s, f)), "document_id:i asset direction severity:d novelty:d confidence:d", f"SELECT document_id, asset, direction, severity, 0.5 AS novelty, 0.25 AS confidence FROM ({REPLIES}) WHERE problems = ''")
register("k3_replies_set_aside", lambda s, f: Y.set_aside(replies(s, f)).select("document_id", F.array_join("problems", ",").alias("problems")), "document_id:i problems", f"SELECT document_id, problems FROM ({REPLIES}) WHERE problems <> ''")


def late_rows(s: SparkSession, f: str) -> DataFrame:
    """Later events arrive first; of the others, which come second, those behind the stored head are set aside."""
    out = scratch.folder(s, "late")
    e = J.source(s, f"{f}/events.parquet").select("event_id", c("ts").cast("timestamp").alias("at"))
    J.run_appender(e.where("event_id % 2 = 0"), J.appender(out, ["event_id"], ["at"], "at", run="even"), f"{out}-s1")
    J.run_appender(e.where("event_id % 2 = 1"), J.appender(out, ["event_id"], ["at"], "at", run="odd"), f"{out}-s2")
    return s.read.parquet(f"{out}-late/batch=*").select("event_id")


register("j3_late_rows", late_rows, "event_id:i", "SELECT event_id FROM events WHERE event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0)")


def skewed(s: SparkSession, f: str) -> DataFrame:
    d = J.source(s, f"{f}/documents.parquet").select("doc_id", F.timestamp_seconds(F.lit(1704067200) + c("doc_id") * 60).alias("retrieved_at"))
    d = d.withColumn("raw", F.date_format(F.timestamp_seconds(F.unix_seconds("retrieved_at") + F.when(c("doc_id") % 4 == 0, 900).otherwise(-60)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return J.finish(d.select("doc_id", X.feed_time(c("raw"), c("retrieved_at"), 300).alias("published_at")), scratch.folder(s, "skew"))


register("j4_stream_clock_skew", skewed, "doc_id:i published_at:t", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) - INTERVAL 60 SECOND END AS published_at FROM documents")


ENTRY = ["as_of", "rows", "active_rows", "status", "content_sha"]


def overlap(s: SparkSession, root: str, as_of: str, matured: DataFrame) -> K.Commit:
    """One scheduled run: the dataset known at ``as_of``, its maturity and one more trajectory row per asset, published as one commit.

    The run builds on the head that it finds and fails if another run gets there first; a repeated run publishes nothing."""
    now = K.head(s, root)
    dataset = matured.select("asset", "series_id", F.unix_seconds("ts").alias("at"), c("event_count").cast("long").alias("event_count"), c("target_positive").cast("long").alias("target_positive"))
    state = corpus.maturity_of(matured).drop("r")
    entries = state.join(L.content_hash(dataset, ["asset"]).drop("rows"), "asset").select("asset", F.lit(as_of).alias("as_of"), "rows", "active_rows", "status", "content_sha")
    old = s.read.parquet(now.tables["trajectory"]) if now else None
    trajectory = L.extend(old, entries, "asset", "as_of", ENTRY).persist()
    try:
        if now and trajectory.count() == old.count():  # a row per asset and run
            return now
        return K.publish(s, root, {"dataset": dataset, "maturity": state, "trajectory": trajectory}, {"as_of": as_of}, now.sha if now else None)
    finally:
        trajectory.unpersist()


RUNS = ["2024-01-12 00:00:00", "2024-01-20 00:00:00", corpus.CUT]


def overlap_runs(s: SparkSession, f: str) -> DataFrame:
    """Three runs, the last of them twice: the trajectory that is left."""
    root = scratch.folder(s, "overlap")
    rows = corpus.windowed(s, f)
    for cut in [*RUNS, RUNS[-1]]:
        overlap(s, root, cut, E.matured(rows, F.lit(cut).cast("timestamp")))
    K.history(s, root)
    return K.table(s, root, "trajectory")


def overlap_sql() -> str:
    part = lambda i: f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR"
    row = "sha256('series_id=' || series_id || '|at=' || epoch(ts)::BIGINT || '|event_count=' || event_count::BIGINT || '|target_positive=' || (target_return > 0)::BIGINT)"
    runs = []
    for i, cut in enumerate(RUNS):
        sums = " || '|' || ".join(part(k) for k in range(4))
        digest = f"SELECT asset, sha256({sums} || '|' || count(*)) AS content_sha FROM (SELECT asset, {row} AS h FROM ({corpus.matured_sql(cut)})) GROUP BY asset"
        before = f"r{i - 1}" if i else "(SELECT NULL::VARCHAR AS asset, 0::BIGINT AS seq, NULL::VARCHAR AS sha WHERE false)"
        runs.append(f"""r{i} AS (SELECT m.asset, '{cut}' AS as_of, m.rows::BIGINT AS rows, m.active_rows::BIGINT AS active_rows, m.status, d.content_sha, coalesce(b.seq, 0) + 1 AS seq, b.sha AS prev_sha,
  sha256(m.asset || '|' || (coalesce(b.seq, 0) + 1) || '|{cut}:' || m.rows || ':' || m.active_rows || ':' || m.status || ':' || d.content_sha || '|' || coalesce(b.sha, '')) AS sha
  FROM ({corpus.maturity_sql(cut)}) m JOIN ({digest}) d USING (asset) LEFT JOIN {before} b ON b.asset = m.asset)""")
    return f"WITH {', '.join(runs)} " + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(RUNS)))


register("j12_overlap_run", overlap_runs, "asset as_of rows:i active_rows:i status content_sha seq:i prev_sha sha", overlap_sql())


def multi_source(s: SparkSession, f: str) -> DataFrame:
    """All venues in one pass: known rows, outcomes against the declared list, the first available as
    primary and the others beside it as of its clock."""
    order = ["9-ABSENT", "5-LOW", "1-URGENT", "2-HIGH"]
    d = pit(bars_1d(s, f), DAY).where(c("available_at") <= F.lit("2000-01-01").cast("timestamp"))
    status = Q.outcomes(d, panel.declared(s, order), "series_id", "ts")
    rank = F.array_position(F.array(*map(F.lit, order)), c("series_id"))
    primary = status.where("status = 'succeeded'").agg(F.min_by("series_id", rank).alias("primary"))  # one row
    marked = d.crossJoin(primary)
    one = marked.where("series_id = primary").select("ts", "available_at", "close", "primary")
    others = marked.where("series_id <> primary").select(c("series_id").alias("venue"), "available_at", c("close").alias("other_close"))
    j = A.asof(A.on_venues(one, others), others, ["other_close"], 2 * DAY, ["venue"])
    return j.groupBy("primary", "venue").agg(F.count("*").alias("rows"), F.count("other_close").alias("matched"), F.avg(A.spread_bps(c("close"), c("other_close"))).alias("mean_bps"))


register("j13_multi_source_build", multi_source, "primary venue rows:i matched:i mean_bps:d", f"""WITH d AS (SELECT * FROM ({pit_sql(BD, DAY)}) WHERE available_at <= TIMESTAMP '2000-01-01'), p AS (SELECT * FROM d WHERE series_id = '5-LOW'), v AS (SELECT DISTINCT series_id AS venue FROM d WHERE series_id <> '5-LOW'),
j AS (SELECT l.venue, l.close, CASE WHEN l.available_at - o.available_at <= INTERVAL 2 DAY THEN o.close END AS oc FROM (SELECT * FROM p, v) l ASOF LEFT JOIN d o ON o.series_id = l.venue AND l.available_at >= o.available_at) SELECT '5-LOW' AS "primary", venue, count(*) AS rows, count(oc) AS matched, avg((close / oc - 1) * 10000) AS mean_bps FROM j GROUP BY 2""")
