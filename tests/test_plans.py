"""Shapes the physical plans must keep."""

import re

import pytest

import __spark_entry__ as contract
from hourgrid.plans.catalog import QUERIES
from hourgrid.operators import bx, cleaning, spikes, stats

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "t")
    spark.range(1000).selectExpr(
        "concat('n', id % 7) AS node",
        "date_add(DATE '2023-12-01', CAST(id DIV 168 AS INT)) AS opr_dt",
        "CAST(id % 24 + 1 AS INT) AS opr_hr",
        "CAST(id % 91 AS DECIMAL(12,4)) AS mw",
        "CAST(id % 13 AS DECIMAL(12,4)) AS mcc",
        "id AS unused",
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_bx_takes_one_shuffle_and_drops_dear_hours_before_it(facts):
    text = plan(bx.bx_daily(facts))
    assert len(re.findall(r"Exchange ", text)) == 1
    assert "row_number(), 10, Partial" in text
    assert "unused" not in text and "mcc" not in text


def test_dedupe_thins_copies_before_the_shuffle(facts):
    text = plan(cleaning.dedupe_keep_first(facts, ["node"], ["unused"]))
    assert "row_number(), 1, Partial" in text


def test_spikes_never_window_a_whole_series(facts):
    text = plan(spikes.price_spikes(facts))
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        assert "node" in keys
    assert "row_number(), 23, Partial" in text


def test_filters_reach_the_scan(facts):
    text = plan(stats.node_summary(facts, "2023-12-02", "2023-12-03"))
    assert "GreaterThan(mw,0.0000)" in text
    assert "GreaterThanOrEqual(opr_dt,2023-12-02)" in text


def test_market_quantiles_stay_off_one_task(facts):
    text = plan(stats.price_statistics(facts, market_summary=True))
    assert "percentile" not in text
    assert "partial_count" in text and "BroadcastHashJoin" in text


EAGER = {
    "append_prices", "backfill_bx", "calculate_bx", "calculate_bx_again", "clear_range",
    "import_zone_files", "ingest_zip", "insert_ignore_table", "refresh_heatmap_one_day",
    "load_batch", "load_batch_bad_archive", "load_report", "load_summary", "parse_price_csv",
    "refresh_heatmap", "refresh_mapping", "reprocess_year", "reprocess_year_resumed",
    "rollup_job", "scan_day", "scan_range", "standardize_csv", "stored_dates",
    "stream_archives", "stream_daily_ingest", "upsert_table", "write_daily",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert operator not in text
