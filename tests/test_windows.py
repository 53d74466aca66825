"""Sliding windows, as-of joins and appends against brute force, at edges of blocks, buckets and watermarks."""

import datetime as dt
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import asof as A
from tideline.operators import events as E
from tideline.streaming import jobs as J
from tideline.streaming.keyed import PARTS, KeyedTable

EVENTS = "asset string, source_id string, direction string, severity double, novelty double, confidence double, source_quality double, available_at timestamp"


def when(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(seconds))


def events(rng, n, span):
    out = []
    for _ in range(n):
        out.append((str(rng.choice(["A", "B"])), None if rng.random() < 0.1 else f"s{rng.integers(4)}", str(rng.choice(["bullish", "bearish", "neutral"])), 0.0 if rng.random() < 0.3 else float(rng.random()), None if rng.random() < 0.1 else float(rng.random()), float(rng.random()), 0.8, when(rng.integers(0, span) * 600)))
    return out


def brute(decisions, rows, seconds):
    out = {}
    for asset, t in decisions:
        w = [r for r in rows if r[0] == asset and r[7] <= t < r[7] + dt.timedelta(seconds=seconds)]
        v = [{"bullish": 1.0, "bearish": -1.0}.get(r[2], 0.0) for r in w]
        g = [r[6] * r[5] * max(r[3], 1e-12) for r in w]
        mean = lambda k: np.mean([r[k] for r in w if r[k] is not None]) if any(r[k] is not None for r in w) else 0.0  # noqa: B023, E731
        most = lambda k: max([r[k] for r in w if r[k] is not None], default=0.0)  # noqa: B023, E731
        out[asset, t] = [
            len(w), sum(x > 0 for x in v), sum(x < 0 for x in v), sum(x == 0 for x in v), np.mean(v) if w else 0, np.dot(v, g) / sum(g) if w else 0, mean(3), most(3), mean(4), most(4), mean(5), mean(6),
            len({r[1] for r in w if r[1]}), (t - max(r[7] for r in w)).total_seconds() if w else seconds,
        ]
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9), (k, got[k], want[k])


@pytest.mark.parametrize("hours", [1, 6])
def test_windows_equal_brute_force(spark, hours):
    rng = np.random.default_rng(hours)
    rows = events(rng, 150, 6 * 48)
    decisions = sorted({(a, when(x)) for a in "AB" for x in [*rng.integers(-40, 6 * 60, 120) * 600, *range(0, 36 * 3600, 3600)]})
    d = spark.createDataFrame(decisions, "asset string, decision_time timestamp")
    e = spark.createDataFrame([*rows, ("A", "s9", "bullish", 1.0, 1.0, 1.0, 1.0, None)], EVENTS).repartition(3)
    found = E.window_features(d, e, hours, ["asset"])
    close({(r.asset, r.decision_time): [r[s] for s in E.STATS] for r in found.collect()}, brute(decisions, rows, hours * 3600))
    n = {(r.asset, r.decision_time): r.pairs for r in E.window_counts(d, e, hours, ["asset"]).collect()}
    assert n == {k: v[0] for k, v in brute(decisions, rows, hours * 3600).items()}
    pairs = E.window_pairs(d, e, hours, ["asset"]).groupBy("asset", "decision_time").count().collect()
    assert {(r.asset, r.decision_time): r["count"] for r in pairs} == {k: v for k, v in n.items() if v}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_windows_keep_other_columns_and_repeats(spark):
    d = spark.createDataFrame([("A", when(0), 1), ("A", when(0), 2), ("B", None, 3)], "asset string, decision_time timestamp, k int")
    none = spark.createDataFrame([], EVENTS)
    got = E.window_features(d, none, 1, ["asset"]).collect()
    assert sorted(r.k for r in got) == [1, 2, 3] and all(r.event_count == 0 and r.last_event_age_seconds == 3600 for r in got)


@pytest.mark.parametrize("tolerance", [None, 50, 5000])
def test_asof_across_buckets(spark, tolerance):
    rng = np.random.default_rng(4)
    right = [("a", when(t), float(i)) for i, t in enumerate(np.unique(rng.integers(0, 20_000, 60)))] + [("b", when(500), 7.0), ("b", None, 9.0)]
    left = [(k, when(t), int(t)) for k in "abc" for t in rng.integers(0, 30_000, 90)] + [("a", None, -1)]
    l = spark.createDataFrame(left, "series_id string, available_at timestamp, n int")
    r = spark.createDataFrame(right, "series_id string, available_at timestamp, x double")

    def match(key, t):
        hits = [(a, x) for k, a, x in right if (key is None or k == key) and a is not None and t is not None and a <= t and (tolerance is None or (t - a).total_seconds() <= tolerance)]
        return max(hits)[::-1] if hits else (None, None)

    for keys in (None, []):
        if keys == []:
            r = r.where("series_id = 'a'").drop("series_id")
            right = [x for x in right if x[0] == "a"]
        for bucket in (100, 3600):
            got = A.asof(l, r, ["x"], tolerance, keys, bucket_s=bucket).collect()
            assert len(got) == len(left)
            for g in got:
                assert (g.x, g["x__available_at"]) == match(None if keys == [] else g.series_id, g.available_at), g


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_windows_and_late_events(spark, tmp_path):
    """Statistics of closed windows equal the batch form; an event behind the watermark changes nothing."""
    rng = np.random.default_rng(9)
    rows, dec = events(rng, 120, 6 * 20), "asset string, decision_time timestamp"
    decisions = sorted({(a, when(x)) for a in "AB" for x in rng.integers(0, 6 * 20, 30) * 600})
    folders = {n: str(tmp_path / n) for n in ("d", "e")}
    source = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folders[n])
    land(spark, folders["d"], decisions, dec)
    land(spark, folders["e"], rows, EVENTS)

    def run():
        q = J.trailing_statistics(source("d", dec), source("e", EVENTS), 7200, "1 hour", "asset").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(got) == len({(r.asset, r.decision_time) for r in got})
        return {(r.asset, r.decision_time): [r[s] for s in E.STATS] for r in got}

    first = run()
    mark = min(max(t for _, t in decisions), max(r[7] for r in rows)) - dt.timedelta(hours=1)
    closed = [k for k in decisions if k[1] <= mark - dt.timedelta(hours=2)]
    close(first, brute(closed, rows, 7200))
    land(spark, folders["e"], [("A", "s0", "bullish", 1.0, 1.0, 1.0, 1.0, closed[-1][1])], EVENTS)  # too late
    land(spark, folders["d"], [("A", when(10**6)), ("B", when(10**6))], dec)
    land(spark, folders["e"], [("A", "s0", "neutral", 0.5, 0.5, 0.5, 0.8, when(10**6))], EVENTS)
    close(run(), brute(decisions, rows, 7200))


def test_stream_pairs(spark, tmp_path):
    land(spark, str(tmp_path / "d"), [("A", when(7200), 1), ("B", when(0), 2)], "asset string, decision_time timestamp, k int")
    land(spark, str(tmp_path / "e"), [("A", when(t), t) for t in (3600, 3601, 7200, 7201)], "asset string, available_at timestamp, n int")
    read = lambda n, schema: spark.readStream.schema(schema).parquet(str(tmp_path / n))
    pairs = J.trailing_pairs(read("d", "asset string, decision_time timestamp, k int"), read("e", "asset string, available_at timestamp, n int"), 3600, "1 hour", "asset")
    got = J.finish(pairs, str(tmp_path / "out")).collect()
    assert sorted((r.k, r.n) for r in got) == [(1, 3601), (1, 7200)]


def test_stream_pairs_meet_by_bucket(spark, tmp_path):
    """A decision's state look-up is bound to its own time, and no pair is lost or repeated at the edges of buckets."""
    rng = np.random.default_rng(5)
    dec, ev = "asset string, decision_time timestamp, k int", "asset string, available_at timestamp, n int"
    decisions = [(str(rng.choice(["A", "B"])), when(t * 900), i) for i, t in enumerate(rng.integers(0, 200, 60))]
    rows = [(str(rng.choice(["A", "B"])), when(t * 900), i) for i, t in enumerate(rng.integers(0, 200, 150))]
    land(spark, str(tmp_path / "d"), decisions, dec)
    land(spark, str(tmp_path / "e"), rows, ev)
    read = lambda n, schema: spark.readStream.schema(schema).parquet(str(tmp_path / n))
    pairs = J.trailing_pairs(read("d", dec), read("e", ev), 3600, "1 hour", "asset")
    assert pairs.columns == ["asset", "decision_time", "k", "available_at", "n"]
    assert "_tl_b" in pairs._jdf.queryExecution().analyzed().toString().split("Join ")[1].split("\n")[0]
    got = sorted((r.k, r.n) for r in J.finish(pairs, str(tmp_path / "out")).collect())
    assert got == sorted((k, n) for a, t, k in decisions for b, u, n in rows if a == b and dt.timedelta(0) <= t - u < dt.timedelta(hours=1))


def test_stream_spans(spark, tmp_path, monkeypatch):
    """Pairs by spans equal brute force over blocks, parts and batches; rows that wait or come again meet once, late ones don't."""
    for name, n in (("BLOCK", 2), ("PART", 8), ("SLICE", 5)):
        monkeypatch.setattr(J, name, n)
    rng = np.random.default_rng(8)
    dec, ev = "asset string, decision_time timestamp, k long", "asset string, available_at timestamp, n int"
    decisions = [(str(rng.choice(["A", "B"])), when(t * 300), i) for i, t in enumerate(rng.integers(0, 300, 90))] + [(None, when(0), 90), ("A", None, 91)]
    rows = [(str(rng.choice(["A", "B"])), when(t * 300), i) for i, t in enumerate(rng.integers(0, 300, 400))] + [(None, when(0), 400), ("A", None, 401)]
    far = dt.datetime(2500, 1, 1)
    folders = {n: str(tmp_path / n) for n in ("d", "e")}
    read = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folders[n])

    def run():
        spans = J.finish(J.trailing_spans(read("d", dec), read("e", ev), 3600, "2 days", "asset", "k", "n"), str(tmp_path / "out"))
        got = J.spanned(spans, "asset", "k", "n")
        assert got.columns == ["asset", "k", "n", "decision_time", "available_at"]
        return sorted((r.asset, r.k, r.n, r.decision_time, r.available_at) for r in got.collect())

    def brute_pairs():
        return sorted((a, k, n, t, u) for a, t, k in decisions for b, u, n in rows if a and t and u and a == b and dt.timedelta(0) <= t - u < dt.timedelta(hours=1))

    for part in range(3):  # out of order, within the lateness
        land(spark, folders["d"], decisions[part::3], dec)
        land(spark, folders["e"], rows[part::3], ev)
    assert run() == brute_pairs()
    decisions += [("A", far, 100), ("A", far, 100)]
    rows += [("A", far - dt.timedelta(minutes=5), 500)]
    land(spark, folders["d"], decisions[-2:], dec)
    land(spark, folders["e"], rows[-1:], ev)
    assert run() == brute_pairs()
    land(spark, folders["e"], [("A", decisions[0][1], 600), ("B", decisions[0][1], 601)], ev)  # too late
    land(spark, folders["d"], [("A", far + dt.timedelta(minutes=5), 101)], dec)
    decisions.append(("A", far + dt.timedelta(minutes=5), 101))
    assert run() == brute_pairs()


def test_stream_windows_of_repeated_decisions(spark, tmp_path):
    """A decision that comes twice has its statistics once, and none of them twice over, over several batches."""
    rng = np.random.default_rng(6)
    rows, dec = events(rng, 200, 6 * 20), "asset string, decision_time timestamp"
    decisions = [(a, when(x)) for a in "AB" for x in rng.integers(0, 6 * 20, 30) * 600] * 2 + [("C", when(1200))]
    end = [("A", "s0", "neutral", 0.5, 0.5, 0.5, 0.8, when(10**6))]
    rows.sort(key=lambda r: r[7])
    decisions.sort(key=lambda r: r[1])
    for part in range(2):  # in order of time
        land(spark, str(tmp_path / "d"), decisions[part * 60 : part * 60 + 60] + [("A", when(10**6))] * part + decisions[120:] * part, dec)
        land(spark, str(tmp_path / "e"), rows[part * 100 : part * 100 + 100] + end * part, EVENTS)
    read = lambda n, schema: spark.readStream.schema(schema).parquet(str(tmp_path / n))
    got = J.finish(J.trailing_statistics(read("d", dec), read("e", EVENTS), 7200, "1 hour", "asset"), str(tmp_path / "out")).collect()
    assert len(got) == len(set(decisions))
    close({(r.asset, r.decision_time): [r[s] for s in E.STATS] for r in got}, brute(sorted(set(decisions)), rows + end, 7200))


ROWS = "id long, at timestamp, v string"


def test_append_opens_only_files_that_may_hold_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda ids, v="x": spark.createDataFrame([(int(i), when(int(i)), v) for i in ids], ROWS)
    append = J.appender(path, ["id"], ["v"], "at")
    for b in range(6):
        append(frame(range(b * 500, (b + 1) * 500)), b)
    table = KeyedTable(spark, path, ["id"], "at")
    assert table.newest["rows"] == 3000 and table.rows().count() == 3000 and table.head == 2999 * 1_000_000 + int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    new, opened = table.unknown(frame([777]))
    assert new.count() == 0 and 1 <= opened <= 2  # of 96 files
    new, opened = table.unknown(frame(range(10_000, 10_020)))
    assert new.count() == 20 and opened <= 6
    new, opened = table.unknown(frame(range(0, 3000)))
    assert new.count() == 0 and opened == 6 * PARTS
    append(frame(range(2990, 3010)), 6)
    assert KeyedTable(spark, path, ["id"], "at").newest["rows"] == 3010
    append(frame(range(5000, 5010)), 6)  # a batch that has been done
    assert KeyedTable(spark, path, ["id"], "at").newest["rows"] == 3010


def test_append_conflicts_late_rows_and_failed_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame([(i, when(t), v) for i, t, v in rows], ROWS)
    append = J.appender(path, ["id"], ["v"], "at")
    append(frame([(1, 100, "a"), (2, 200, "b"), (2, 200, "b")]), 0)
    with pytest.raises(ValueError, match="different payloads"):
        append(frame([(3, 300, "a"), (3, 300, "b")]), 1)
    spark.createDataFrame([(9, when(9), "half")], ROWS).write.parquet(f"{path}/batch=main-1/part=0")  # data of a batch that died before its manifest
    append(frame([(1, 400, "other"), (4, 150, "late"), (5, 500, "new")]), 1)
    assert {r.id for r in KeyedTable(spark, path, ["id"], "at").rows().collect()} == {1, 2, 5}
    assert [r.id for r in spark.read.parquet(f"{path}-late/batch=main-1").collect()] == [4]
    append(frame([]), 2)
    assert KeyedTable(spark, path, ["id"], "at").has("main-2") and len(glob.glob(f"{path}-manifest/*.json")) == 3
    two = KeyedTable(spark, path, ["id"], "at")
    append(frame([(6, 600, "x")]), 3)
    with pytest.raises(RuntimeError, match="another writer"):
        two.append("main-3", frame([(7, 700, "y")]))


def test_window_counts_of_nothing(spark):
    d = spark.createDataFrame([("A", when(0))], "asset string, decision_time timestamp")
    assert E.window_counts(d, spark.createDataFrame([], EVENTS), 1, ["asset"]).first().pairs == 0
    assert E.window_features(d.limit(0), spark.createDataFrame([], EVENTS), 1, ["asset"]).where(F.lit(True)).count() == 0


def test_latch_equals_row_by_row_and_carries_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    for n in (0, 1, 200):
        e, x = rng.random(n) < 0.3, rng.random(n) < 0.3
        for active in (False, True):
            now, want = active, []
            for a, b in zip(e, x, strict=True):
                now = False if now and b else True if not now and a else now
                want.append(now)
            assert J.latched(e, x, active).tolist() == want
    schema = "key string, ts timestamp, entry boolean, exit boolean"
    rows = [("a", when(i), bool(rng.random() < 0.3), None if rng.random() < 0.1 else bool(rng.random() < 0.4)) for i in range(60)]
    for lo in range(0, 60, 20):
        land(spark, str(tmp_path / f"in/{lo}"), rows[lo : lo + 20], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = [r.regime for r in J.finish(J.latch(stream, "key", "entry", "exit"), str(tmp_path / "out")).orderBy("ts").collect()]
    whole = J.latched(np.array([bool(r[2]) for r in rows]), np.array([bool(r[3]) for r in rows]), False)
    assert got == whole.astype(float).tolist()
