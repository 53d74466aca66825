"""Properties of single operators on small tables made by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.operators import asof as A
from tideline.operators import extraction as Y
from tideline.operators import features as N
from tideline.operators import folds as D
from tideline.operators import ledger as L
from tideline.operators import prob as R
from tideline.operators import stats as T
from tideline.settings import Split
from tideline.sources import store


def stamp(df, *cols):
    return df.withColumns({c: F.timestamp_seconds(F.col(c)) for c in cols})


def test_asof_exact_stale_and_future(spark):
    left = stamp(spark.createDataFrame([("a", 100), ("a", 200), ("a", 90)], "series_id string, available_at long"), "available_at")
    right = stamp(spark.createDataFrame([("a", 100, 1.0), ("a", 150, 2.0), ("a", 300, 9.0), ("b", 90, 7.0)], "series_id string, available_at long, x double"), "available_at")
    got = {r.s: (r.x, r.p) for r in A.asof(left, right, ["x"], 40).select(F.unix_seconds("available_at").alias("s"), "x", F.unix_seconds("x__available_at").alias("p")).collect()}
    assert got == {100: (1.0, 100), 200: (None, None), 90: (None, None)}
    with pytest.raises(ValueError):
        A.asof(left.withColumn("x", F.lit(1.0)), right, ["x"])


def test_ema_over_many_chunks(spark):
    x = np.random.default_rng(3).normal(100, 5, 1000)
    df = stamp(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 5.0)], "series_id string, ts long, close double"), "ts")
    got = N.ema(df, "close", 20, "e").where("series_id = 'a'").orderBy("ts").toPandas()["e"]
    want = pd.Series(x).ewm(span=20, adjust=False, min_periods=20).mean()
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_latch_toggles_when_both_hold(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, bool(rng.random() < 0.3), bool(rng.random() < 0.3)) for i in range(300)]
    got = [r.on for r in N.latch(stamp(spark.createDataFrame(rows, "series_id string, ts long, e boolean, x boolean"), "ts"), "e", "x", "on").orderBy("ts").collect()]
    on, want = 0, []
    for _, _, e, x in rows:
        on = 0 if on and x else 1 if not on and e else on
        want.append(float(on))
    assert got == want


def test_purge_leaves_no_label_past_the_boundary(spark):
    rows = [("a", i, i, 60 * i, 60 * (i + 3), 1.0) for i in range(260)]
    df = stamp(spark.createDataFrame(rows, "series_id string, pos long, ts long, decision_time long, label_available_at long, target_positive double"), "ts", "decision_time", "label_available_at")
    folds = D.sealed_folds(df.groupBy("series_id").agg(F.count("*").alias("n")), Split())
    got = D.purge(df, folds)
    assert folds.where("part = 'test'").count() == 2
    assert got.where("part <> 'test' AND label_available_at > known_by").count() == 0
    assert got.where("part = 'test' AND fold = 0").count() == 30


def test_chain_breaks_once_per_edit(spark):
    d = L.chain(spark.createDataFrame([("l", i, f"p{i}") for i in range(20)], "ledger string, ts long, p string"), "ledger", ["ts"], F.col("p"))
    assert L.chain_report(d, "ledger").first().broken == 0
    edited = d.withColumn("sha", F.when(F.col("seq") == 7, "0").otherwise(F.col("sha")))
    r = L.chain_report(edited, "ledger").first()
    assert (r.broken, r.roots, r.rows) == (1, 1, 20)


def test_content_hash_ignores_order_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    h = lambda df: L.content_hash(df).first().content_sha
    assert h(a) == h(a.orderBy(F.desc("k")))
    assert h(a) != h(a.union(a.limit(1)))


def test_logistic_has_no_gradient_left():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    w = R.newton_logistic(x, y, 1.0)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(np.r_[(p - y).sum(), x.T @ (p - y) + w[1:]]).max() < 1e-6


def test_bootstrap_finds_an_edge(spark):
    rng = np.random.default_rng(2)
    rows = [("edge", i, float(v)) for i, v in enumerate(rng.normal(0.5, 1, 300))] + [("none", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 300))]
    got = {r.key: r for r in T.block_bootstrap(spark.createDataFrame(rows, "key string, pos long, d double"), "key", 200, 6, 7).collect()}
    assert got["edge"].pvalue < 0.02 < got["none"].pvalue
    assert got["edge"].ci_low > 0


def test_urls_and_times(spark):
    urls = ["HTTP://Ex.com:80/a/?utm_x=1&b=2&a=1#f", "https://u:p@h.org/", "ftp://h.org/", "https://h.org:8443", None]
    got = [r.u for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, v string").select("i", X.canonical_url(F.col("v")).alias("u")).orderBy("i").collect()]
    assert got == ["http://ex.com/a?a=1&b=2", None, None, "https://h.org:8443/", None]


def test_snapshot_refuses_other_content(spark, tmp_path):
    df = stamp(spark.createDataFrame([(1, 10, 20), (2, 11, 21)], "k long, ts long, available_at long"), "ts", "available_at")
    path = f"file://{tmp_path}/snap"
    assert store.write_snapshot(df, path, "ts", "1970-01-02 00:00:00") == "written"
    assert store.write_snapshot(df, path, "ts", "1970-01-02 00:00:00") == "unchanged"
    with pytest.raises(ValueError):
        store.write_snapshot(df.limit(1), path, "ts", "1970-01-02 00:00:00")
    with pytest.raises(ValueError):
        store.write_snapshot(df, f"{path}2", "ts", "1970-01-01 00:00:15")
    assert store.read_snapshot(spark, path, "ts").count() == 2


def supervised(spark, n=160):
    """Rows of three keys: two classes, one class, no train rows; with missing values and a constant column."""
    rng = np.random.default_rng(7)
    rows = []
    for key in ("two", "one", "none"):
        for i in range(n):
            x = rng.normal(size=2)
            y = float(x[0] + rng.normal() > 0) if key == "two" else 1.0
            part = "test" if key == "none" or i % 4 == 3 else "calibration" if i % 4 == 2 else "train"
            rows.append((key, part, i, y, None if i % 9 == 0 else float(x[0]), float("nan") if i % 7 == 0 else float(x[1]), 3.0))
    return spark.createDataFrame(rows, "key string, part string, ts int, y double, a double, b double, flat double").repartition(5), rows


def test_fits_from_sums_equal_those_of_one_task(spark):
    df, rows = supervised(spark)
    got = {(r.key, r.ts): r.p for r in R.ridge_logistic(df, ["key"], ["a", "b", "flat"]).collect()}
    two = [r for r in rows if r[0] == "two"]
    x = np.array([[np.nan if v is None else v for v in r[4:]] for r in two], float)
    train = np.array([r[1] == "train" for r in two])
    x = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
    scale = x[train].std(axis=0)
    z = (x - x[train].mean(axis=0)) / np.where(scale == 0, 1, scale)
    y = np.array([r[3] for r in two])
    w = R.newton_logistic(z[train], y[train], 1.0)
    want = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
    np.testing.assert_allclose([got["two", r[2]] for r in two], want, atol=1e-8)
    assert all(got["one", r[2]] == 1 - 1e-6 and got["none", r[2]] == 0.5 for r in two)
    scored = spark.createDataFrame([(*r[:4], float(p)) for r, p in zip(two, want, strict=True)], "key string, part string, ts int, y double, p double")
    cal = np.array([r[1] == "calibration" for r in two])
    q = np.log(want / (1 - want))
    v = R.newton_logistic(q[cal][:, None], y[cal], 1e-6)
    again = {r.ts: r.p for r in R.platt(scored, ["key"]).collect()}
    np.testing.assert_allclose([again[r[2]] for r in two], 1 / (1 + np.exp(-(v[0] + v[1] * q))), atol=1e-8)
    assert {r.p for r in R.platt(scored.withColumn("p", F.lit(0.3)), ["key"]).collect()} == {np.clip(y[cal].mean(), 1e-6, 1 - 1e-6)}


def test_sums_of_a_column_set_are_part_of_the_whole(spark):
    df, _ = supervised(spark, 20)
    all_, some = R.gram(df, ["key"], ["a", "b", "flat"], "y").orderBy("key").collect(), R.gram(df, ["key"], ["a", "flat"], "y").orderBy("key").collect()
    for x, y in zip(all_, some, strict=True):
        assert np.allclose([x.xx_0_0, x.xx_0_1, x.xx_0_3, x.xx_1_1, x.xx_1_3, x.xx_3_3, x.xy_1, x.xy_3], [y.xx_0_0, y.xx_0_1, y.xx_0_2, y.xx_1_1, y.xx_1_2, y.xx_2_2, y.xy_1, y.xy_2])


def test_boosted_trees_learn_with_gaps_and_one_class(spark):
    df, rows = supervised(spark)
    got = {(r.key, r.ts): r.p for r in R.boosted_trees(df, ["key"], ["a", "b"], trees=8).collect()}
    assert len(got) == len(rows)
    two = [r for r in rows if r[0] == "two" and r[1] == "train" and r[4] is not None]
    assert np.mean([(got["two", r[2]] > 0.5) == (r[3] > 0) for r in two]) > 0.7
    assert all(got["one", r[2]] == 1 - 1e-6 and got["none", r[2]] == 0.5 for r in two)


def test_tree_scores_are_one_read_for_all_keys(spark):
    df, _ = supervised(spark)
    keys = F.explode(F.array(*map(F.lit, "abc"))).alias("key")
    got = R.boosted_trees(df.where("key = 'two'").select(keys, *[x for x in df.columns if x != "key"]), ["key"], ["a", "b"], trees=2)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    scores = [{r.ts: r.p for r in got.where(F.col("key") == k).collect()} for k in "abc"]
    assert len(scores[0]) == df.where("key = 'two'").count() and scores[0] == scores[1] == scores[2]


def test_urls_are_decoded_sorted_and_encoded(spark):
    want = {
        "HTTP://Example.COM:80/a//?b=2&a=1&utm_x=3&ref=q#f": "http://example.com/a?a=1&b=2", "http://bücher.de/ä?q=%C3%A9+x&k&z=1%zz": "http://xn--bcher-kva.de/ä?k=&q=%C3%A9+x&z=1%25zz",
        "http://h?b=2&B=1&b=1": "http://h/?B=1&b=1&b=2", "http://h/?a=%7E*-._": "http://h/?a=~%2A-._", "https://[2001:DB8::1]:8443/x": "https://2001:db8::1:8443/x", "https://h.:443": "https://h/",
        "http://h:/x": "http://h/x", "http://h:99999/": None, "http://a..b/": None, "http://u@h/": None, "ftp://h/x": None,
    }
    df = spark.createDataFrame([(u,) for u in want], "v string")
    assert {r.v: r.c for r in df.select("v", X.canonical_url(F.col("v")).alias("c")).collect()} == want


def test_public_hosts_are_globally_routable(spark):
    want = {"8.8.8.8": True, "2606:4700::1111": True, "example.com": True, "10.1.1.1": False, "100.64.0.1": False, "192.0.2.4": False, "2001:db8::1": False, "::1": False, "localhost": False, "a.localhost": False, "": False}
    df = spark.createDataFrame([(x,) for x in want], "v string")
    assert {r.v: r.p for r in df.select("v", X.public_host(F.col("v")).alias("p")).collect()} == want


def test_relevance_looks_at_folded_text(spark):
    df = spark.createDataFrame([("A \ufb01ne\u00a0\n STRASSE",), ("nothing  here",), (None,)], "v string")
    got = [r.r.included for r in df.select(X.relevance(X.fold(F.col("v")), ["fine strasse", "nothing here"], []).alias("r")).collect()]
    assert got == [["fine strasse"], ["nothing here"], []]


def test_feed_counts(spark):
    from tideline.sources import landed as S

    item = lambda title, link: f"<item><title>{title}</title><link>{link}</link></item>"
    feed = [item("a", "https://x.org/1"), item("a", "https://x.org/1?utm_a=1"), item("", "https://x.org/2"), item("b", "nothing"), item("c", "https://y.org/"), item("d", "https://x.org/3"), item("e", "https://x.org/4")]
    df = spark.createDataFrame([("s", f"<rss>{''.join(feed)}</rss>"), ("none", "<rss></rss>")], "source_id string, payload string").withColumn("retrieved_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.source_id: (r.entries, r.truncated, r.skipped, r.duplicates, r.kept) for r in S.feed_counts(df, ["x.org"], 6, 300).collect()}
    assert got == {"s": (7, 1, 3, 1, 2), "none": (0, 0, 0, 0, 0)}


def test_filters_on_replies_ask_the_extractor_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "document_id long, text string")
    made = Y.extracted(docs, "text", lambda prompt, texts: texts.map(lambda x: "{" if len(x) % 2 else '{"asset": "BTC", "direction": "neutral", "severity": 0.5, "novelty": 0.5, "confidence": 0.5}'), "")
    for rows, ids in ((Y.set_aside(made).select("document_id", "problems"), [1]), (Y.accepted(made), [2, 3])):
        assert sorted(r.document_id for r in rows.collect()) == ids
        assert rows._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
