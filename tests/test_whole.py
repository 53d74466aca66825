"""Queries return rows for the whole of their input, not for a part of it."""

import __spark_entry__ as entry
from tideline.plans import market, research


def test_boosted_trees_score_every_fold(spark, sf_dir):
    want = market.assigned(spark, sf_dir).where("part = 'test'").select("series_id", "fold", "ts")
    got = entry.queries()["i11_boosted_trees"](spark, sf_dir)
    assert want.select("series_id", "fold").distinct().count() > 1
    assert got.count() == want.count()
    assert got.select("series_id", "fold").distinct().count() == want.select("series_id", "fold").distinct().count()
    assert got.where("p IS NULL OR p NOT BETWEEN 0 AND 1").count() == 0


def tables(spark, folder, docs, events):
    """documents (doc_id, text) and events (event_id) with fixed values in the other columns."""
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source")
    e = spark.createDataFrame([(i,) for i in events], "event_id long").selectExpr("event_id", "timestamp_seconds(1704067200 + event_id) AS ts", "1L AS user_id", "'view' AS event_type", "10.0D AS value")
    d.write.parquet(f"{folder}/documents.parquet")
    e.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_pending_reads_all_stored_calls(spark, tmp_path):
    folder = tables(spark, tmp_path, [(i, "x") for i in range(2000)], range(300, 1500))
    got = {r.document_id for r in entry.queries()["d11_pending_extraction"](spark, folder).collect()}
    assert got == {i for i in range(2000) if not (300 <= i < 1500 and i % 23)}


def test_keyword_classes_read_the_whole_text(spark, tmp_path):
    ends = {0: "a hack", 1: "a RATE CUT", 2: "the sec said", 3: "a new release", 4: "nothing", 5: "a release after a hack"}
    folder = tables(spark, tmp_path, [(i, "word " * 500 + w) for i, w in ends.items()] + [(6, ""), (7, None)], [1])
    got = {r.document_id: r.event_type for r in entry.queries()["c14_whole_text_classes"](spark, folder).collect()}
    assert got == {0: "security_incident", 1: "monetary_policy", 2: "regulation", 3: "protocol_release", 4: "general_update", 5: "security_incident", 6: "general_update", 7: "general_update"}


def test_ablations_run_the_sealed_protocol(spark, sf_dir):
    got = entry.queries()["i16_ablation_run"](spark, sf_dir).toPandas()
    folds = market.assigned(spark, sf_dir).select("series_id", "fold").distinct().count()
    assert got.ablation.nunique() == 7 and len(got) == folds * 7 * 3 * 3
    assert got[got.model == "trend"][["threshold", "brier"]].isna().all().all()
    assert got[got.model != "trend"][["threshold", "brier"]].notna().all().all()
    assert set(got.cost_multiplier) == {1.0, 1.5, 2.0}


def test_sealed_runs_read_events_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(research, "MODELS", {"prior": research.MODELS["prior"]})
    for name in ("i14_sealed_benchmark", "i14_sealed_predictions"):
        got = entry.queries()[name](spark, sf_dir)  # what is left to do starts from tables
        assert got.inputFiles() and not [x for x in got.inputFiles() if "events.parquet" in x]
        assert {r.model for r in got.select("model").distinct().collect()} == {"prior", "trend"}
