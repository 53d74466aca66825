"""Every query runs, and equals its DuckDB twin where it has one."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tideline.plans import catalog
from tideline.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# a sample that touches each operator module; the driver compares all queries
CHECKED = ["flagship_trend_metrics", "f3_ema", "f8_i4_trend_exposure", "b5_i5_supervised", "e5_sealed_metrics", "g1_choose_threshold", "i3_walk_forward", "d1_asof_backward", "d2_c5_venue_spread", "e1_bar_quality", "e2_cross_venue",
           "b1_ohlcv_contract", "e6_probability_metrics", "e18_e19_moments", "e21_block_bootstrap", "e13_fold_concentration", "c10_canonical_url", "b8_relevance", "d12_f14_chain_report", "h5_content_hash", "g4_round_robin",
           "e22_f15_event_windows_24h", "e23_c21_maturity", "i20_aligned_forecasts", "a3_candle_pages", "a10_chart_json", "j5_stream_bars", "j2_stream_append", "j7_stream_latch"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
            return ""
        return f"{float(v):.5f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) or type(v).__name__ == "bool" else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_equals_twin(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    num = lambda rows: [tuple(f"{float(x):.4f}" if x.replace(".", "", 1).replace("-", "").replace("e", "").isdigit() and x else x for x in r) for r in rows]
    assert num(plain(got)) == num(plain(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


def twin_on(spark, name, folder, **tables):
    """A query and its twin over tables made by hand, as sorted rows of text."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return plain(entry.queries()[name](spark, str(folder)).toPandas()), plain(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["a5_funding", "a6_open_interest"])
def test_rates_of_one_time_give_the_last(spark, sf_dir, tmp_path, name):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 500")
    again = e.withColumns({"event_id": e.event_id + 1000, "value": e.value + 3.0})
    got, want = twin_on(spark, name, tmp_path, events=e.unionByName(again))
    assert len(got) == 5 and got == want


def test_markup_with_odd_references(spark, tmp_path):
    bodies = ["a &ampb &amp;lt; &amp c", "&notin; &notit; &nosuch; &;&& &#", "&#65;&#x42&#0;&#128;&#xD800;&#x110000;&#99999999999999999999;&#xFDD0;|", "a&nbsp;&#x2003; \x0bb\xa0", "<style>x<script>y</style>z</script>w", "it&apos;s &NotEqualTilde; &hellip", "", None]
    pages = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")
    got, want = twin_on(spark, "c9_strip_markup", tmp_path, pages=pages)
    assert got == want and ("a &b &lt; & c", "0") in got


def test_stream_pairs_store_no_pairs(spark, tmp_path, monkeypatch):
    """What the stream of pairs writes grows with its rows; the pairs come from it on reading, whole."""
    kept, finish = [], jobs.finish
    monkeypatch.setattr(jobs, "finish", lambda *x: kept.append(finish(*x)) or kept[-1])
    e = spark.range(1200).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:30:00' + make_dt_interval(0, 0, 0, id % 600 * 5) AS ts", "id AS user_id", "if(id % 4 = 0, 'signup', 'view') AS event_type", "5.0D AS value")
    got, want = twin_on(spark, "j6_stream_pairs", tmp_path, events=e, documents=spark.range(7).selectExpr("id AS doc_id"))
    assert got == want and len(got) > 10_000
    assert kept[0].count() <= 1200 + 2 * 300
