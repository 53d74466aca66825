"""Numbering, chains, commits, selections, extraction and candidate verdicts on small tables."""

import datetime as dt
import hashlib
import math
import subprocess
import sys
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.functions import normal
from tideline.functions import text as X
from tideline.operators import extraction as Y
from tideline.operators import features as N
from tideline.operators import ledger as L
from tideline.operators import stats as T
from tideline.sources import commits as K


@pytest.mark.parametrize("width", [0.5, 7, 10**9])
def test_places_equal_row_number(spark, width):
    rng = np.random.default_rng(2)
    rows = [(None if i % 13 == 0 else "ab"[i % 2], None if i % 17 == 0 else int(rng.integers(-40, 60)), i) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, t long, i long").repartition(4)
    got = {r.i: r.seq for r in L.numbered(d, ["k"], ["t", "i"], width).collect()}
    want = {r.i: r.n for r in d.withColumn("n", F.row_number().over(W.Window.partitionBy("k").orderBy("t", "i"))).collect()}
    assert got == want and len(got) == 200


def test_chain_links_across_chunks(spark):
    d = spark.createDataFrame([("a", i * 50_000, f"p{i}") for i in range(20)] + [("b", 5, "x")], "source string, t long, p string")
    rows = sorted(L.chain(d, "source", ["t"], F.col("p")).collect(), key=lambda r: (r.source, r.seq))
    assert rows[0].prev_sha is None and rows[-1].prev_sha is None
    for a, b in zip(rows[:19], rows[1:20]):
        assert b.prev_sha == a.sha == hashlib.sha256(f"a|{a.seq}|{a.p}".encode()).hexdigest()


def test_extend_chains_and_refuses_older_entries(spark):
    entry = lambda t, p: spark.createDataFrame([("m", t, p)], "asset string, as_of string, status string")
    go = lambda old, e: L.extend(old, e, "asset", "as_of", ["as_of", "status"])
    one = go(None, entry("2024-01-01", "x"))
    two = go(one, entry("2024-01-02", "y"))
    assert [(r.seq, r.prev_sha) for r in two.orderBy("seq").collect()] == [(1, None), (2, one.first().sha)]
    assert go(two, entry("2024-01-02", "y")).count() == 2
    with pytest.raises(Exception, match="not later"):
        go(two, entry("2024-01-02", "z")).collect()
    assert go(two, spark.createDataFrame([("other", "2023-01-01", "n")], "asset string, as_of string, status string")).where("asset = 'other' AND seq = 1 AND prev_sha IS NULL").count() == 1


def test_commits_are_whole_and_compared(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    frame = lambda n: spark.range(n)
    assert K.head(spark, root) is None and K.table(spark, root, "a") is None
    one = K.publish(spark, root, {"a": frame(3), "b": frame(1)}, {"as_of": "x"}, None)
    dies = spark.range(2).select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        K.publish(spark, root, {"a": frame(9), "b": dies}, {}, one.sha)  # between the tables
    assert K.head(spark, root) == one and K.table(spark, root, "a").count() == 3
    with pytest.raises(K.Conflict):
        K.publish(spark, root, {"a": frame(4)}, {}, "somebody else's")
    two = K.publish(spark, root, {"a": frame(5)}, {}, one.sha)
    assert K.table(spark, root, "a").count() == 5 and K.table(spark, root, "b").count() == 1 and two.previous == one.sha
    assert [c.seq for c in K.history(spark, root)] == [1, 2]
    path = tmp_path / "run/commits/000000000001.json"
    (tmp_path / "run/commits/.000000000001.json.crc").unlink(missing_ok=True)
    path.write_text(path.read_text().replace('"x"', '"y"'))
    with pytest.raises(ValueError, match="changed"):
        K.history(spark, root)


def test_states_are_judged(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("s", 1, t(5), t(6), "pilot", 1, False), ("s", 2, t(5), t(6), "longitudinal", 9, False), ("s", 3, t(9), t(9), "pilot", 1, True), ("s", 4, t(1), t(8), "pilot", 1, False), ("u", 5, t(1), t(1), "pilot", 1, False)]
    schema = "source string, id long, created_at timestamp, completed_at timestamp, workflow string, run int, expired boolean"
    d = L.judge_states(spark.createDataFrame(rows, schema), "source", "id", F.lit("2024-01-03").cast("timestamp"))
    assert {r.id: r.decision for r in d.collect()} == {1: "selected", 2: "rejected_older", 3: "rejected_expired", 4: "rejected_too_old", 5: "rejected_too_old"}
    got = {r.source: (r.id, r.considered, r.rejected, r.expired, r.too_old) for r in L.selected_states(d, "source", ["id"]).collect()}
    assert got == {"s": (1, 4, 3, 1, 1), "u": (None, 1, 1, 0, 1)}
    with pytest.raises(Exception, match="comes twice"):
        L.judge_states(spark.createDataFrame([rows[0], rows[0]], schema), "source", "id").collect()


def test_replies_are_parsed_and_checked(spark):
    good = '{"asset": "BTC", "direction": "bullish", "severity": 0.5, "novelty": 0.1, "confidence": 0.9, "more": [1]}'
    replies = {"good": good, "cut": good[:30], "no json": "Sure! Here it is", "list": "[1]", "null": None, "missing": '{"asset": "BTC"}', "wrong": good.replace("BTC", "btc").replace("bullish", "up").replace("0.5", "1.5"), "kind": good.replace("0.5", '"high"')}
    d = spark.createDataFrame([(k,) for k in replies] + [(None,)], "text string")
    got = Y.extracted(d, "text", lambda prompt, t: t.map(lambda x: replies.get(x, good) if prompt == "p" else ""), "p")
    want = {"good": [], "cut": ["malformed"], "no json": ["malformed"], "list": ["malformed"], "null": ["malformed"], "missing": ["missing_field"], "wrong": ["asset_form", "direction_name", "severity_range"], "kind": ["malformed"], None: []}
    assert {r.text: r.problems for r in got.collect()} == want
    assert {r.text: (r.asset, r.severity) for r in Y.accepted(got).collect()} == {"good": ("BTC", 0.5), None: ("BTC", 0.5)}
    assert Y.set_aside(got).count() == 7


def test_normal_functions(spark):
    n = NormalDist()
    x = [-38.5, -9.0, -7.2, -3.3, -0.1, 0.0, 0.7, 2.5, 6.9, 8.0, 40.0]
    p = [1e-9, 1e-4, 0.02, 0.025, 0.3, 0.5, 0.77, 0.95, 0.9816, 0.9999]
    got = [r.v for r in spark.createDataFrame([(v,) for v in x], "x double").select(normal.cdf("x").alias("v")).collect()]
    assert np.allclose(got, [math.erfc(-v / math.sqrt(2)) / 2 for v in x], rtol=1e-12, atol=1e-16)
    got = [r.v for r in spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0, None]], "p double").select(normal.inverse("p").alias("v")).collect()]
    assert np.allclose(got[:-3], [n.inv_cdf(v) for v in p], atol=1e-12) and got[-3:] == [None] * 3


def test_terms_are_folded_and_texts_once(spark):
    d = spark.createDataFrame([("Große STRASSE",), ("ſoft  ware",), ("nothing",), (None,)], "v string")
    got = [tuple(r.r) for r in d.select(X.relevance(F.col("v"), ["STRAẞE", "Soft ware", " "], ["GROSSE "]).alias("r")).collect()]
    assert got == [(False, "rejected_excluded_term", ["strasse"], ["grosse"]), (True, "accepted_include_match", ["soft ware"], []), *[(False, "rejected_missing_include_term", [], [])] * 2]
    assert [r.ok for r in d.select(X.relevance(F.col("v"), [], ["x"])["accepted"].alias("ok")).collect()] == [True] * 4
    plan = d.withColumn("r", X.relevance(F.col("v"), ["a", "b"], ["c"])).select("r.accepted", "r.reason", "r.included")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_folding_holds_few_texts_and_no_pandas(spark):
    plan = spark.createDataFrame([("Große",)], "v string").select(X.relevance(F.col("v"), ["a"], ["c"])["accepted"])._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # a hundred rows at a time, not 10,000
    code = "import sys; from tideline.functions.folding import folded_text as f; print(f('\\ufb01X  y'), f(None), sorted({'pandas', 'pyspark'} & set(sys.modules)))"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert got.stdout.split("\n")[0] == "fix y None []"


def test_bootstrap_looks_up_what_it_would_join(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(m, i, float(x)) for m in "ab" for i, x in enumerate(rng.normal(0.1, 1, 40 if m == "a" else 13))], "m string, pos long, d double")
    one, two = (T.block_bootstrap(d, "m", 60, 6, 3, most).orderBy("m").toPandas() for most in (10**6, 0))
    pd.testing.assert_frame_equal(one, two)


def test_candidates_are_ranked(spark):
    d = spark.createDataFrame([("a", False, 0.9, 1.0), ("b", True, 0.5, 0.1), ("c", True, 0.5, 0.2), ("d", False, None, 3.0)], "model string, eligible boolean, dsr double, total_return double")
    assert [r.model for r in T.ranked(d).orderBy("rank").collect()] == ["c", "b", "a", "d"]
    v = T.verdict(d).first()
    assert (v.verdict, v.candidate_count, v.passing_candidate_count, v.passing_candidates) == ("candidate_requires_human_freeze_review", 4, 2, "c,b")
    v = T.verdict(d.where("NOT eligible")).first()
    assert (v.verdict, v.recommended_action, v.passing_candidates) == ("no_candidate_passed", "retain_research_only", "")


def test_averages_of_long_series_in_one_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(100, 5, 1500)
    d = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)] + [("t", 0, 7.0)], "series_id string, ts int, close double").repartition(4)
    spans = {"one": 1, "fast": 12, "slow": 5000}
    got = N.emas(d, "close", spans).where("series_id = 's'").orderBy("ts").toPandas()
    for out, span in spans.items():
        want = pd.Series(x).ewm(span=span, adjust=False, min_periods=span).mean()
        np.testing.assert_allclose(got[out].to_numpy(float), want.to_numpy(), rtol=1e-12)
    plain = N.emas(d, "close", {"slow": 900}).where("series_id = 's'").orderBy("ts").toPandas()
    np.testing.assert_allclose(plain["slow"].to_numpy(float), pd.Series(x).ewm(span=900, adjust=False, min_periods=900).mean().to_numpy(), rtol=1e-12)
