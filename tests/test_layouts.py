"""Files that answer look-ups of one node, and tables that need no shuffle of prices."""

import datetime as dt
import re

import pytest

from hourgrid.operators import bx, heatmaps, rollups
from hourgrid.sources import bucketed, store

DAY = dt.date(2024, 3, 4)
NODES, HOURS, DAYS = 900, 24, 3


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(NODES * HOURS * DAYS).selectExpr(
        f"format_string('N_%04d', id % {NODES}) AS node",
        f"date_add(DATE '{DAY}', CAST(id DIV {NODES * HOURS} * 28 AS INT)) AS opr_dt",
        f"CAST(id DIV {NODES} % {HOURS} + 1 AS INT) AS opr_hr",
        "CAST((id * 7919) % 10007 AS DECIMAL(12,4)) AS mw",
    )


@pytest.fixture(scope="module")
def zones(spark):
    return spark.range(NODES).selectExpr(
        "format_string('N_%04d', id) AS pnode_id",
        "CASE id % 3 WHEN 0 THEN 'NP15' WHEN 1 THEN 'SP15' END AS zone",
    )


def scanned(frame):
    """Rows that the scan of a plain look-up hands on."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_node_is_found_without_reading_the_others(spark, tmp_path, rows):
    path = str(tmp_path / "prices")
    store.write_daily(rows, path)
    one = store.scan_range(spark, path, nodes=["N_0500"], start=DAY, end=DAY)
    assert one.count() == HOURS
    # At most two pages of 2,400 rows, of the 21,600 of the day.
    assert scanned(one) <= 2 * 2400
    assert scanned(store.scan_range(spark, path, nodes=["N_0500x"], start=DAY, end=DAY)) == 0


@pytest.fixture
def tables(spark, tmp_path, rows, zones):
    names = f"prices_{tmp_path.name}", f"mapping_{tmp_path.name}"
    prices = bucketed.open_prices(spark, names[0], str(tmp_path / "prices"), 4)
    mapping = bucketed.open_mapping(spark, names[1], str(tmp_path / "mapping"), 4)
    bucketed.replace_mapping(zones, names[1])
    bucketed.replace_months(rows, names[0])
    yield prices, mapping, names, tmp_path
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text), text


def test_zone_results_shuffle_no_prices(spark, tables, rows, zones):
    prices, mapping, _, _ = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build in (
            bx.bx_zone_pooled,
            bx.bx_zone_of_means,
            heatmaps.month_hour_heatmap,
            lambda p, m: rollups.zone_bx_from_raw(p, m, 6),
        ):
            keys, text = exchanges(build(prices, mapping))
            assert "SortMergeJoin" in text and keys
            assert not [k for k in keys if re.search(r"\bnode#", k)], text
            assert [k for k in exchanges(build(rows, zones))[0] if re.search(r"\bnode#", k)]
            assert sorted(map(tuple, build(prices, mapping).collect()), key=repr) == sorted(
                map(tuple, build(rows, zones).collect()), key=repr
            )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_months_are_replaced_and_tables_open_again(spark, tables, rows):
    prices, _, names, folder = tables
    month = rows.where(f"opr_dt = '{DAY}' AND node < 'N_0300'")
    for _ in range(2):
        bucketed.replace_months(month, names[0])
    expected = rows.where(f"opr_dt <> '{DAY}'").unionByName(month)
    spark.sql(f"DROP TABLE {names[0]}")
    again = bucketed.open_prices(spark, names[0], str(folder / "prices"), 4)
    columns = ["node", "opr_dt", "opr_hr", "mw"]
    assert again.select(*columns).exceptAll(expected).isEmpty()
    assert again.count() == expected.count()


def test_months_are_replaced_whatever_the_session_overwrites(spark, tables, rows):
    prices, _, names, _ = tables
    month = rows.where(f"opr_dt = '{DAY}' AND node < 'N_0300'")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        bucketed.replace_months(month, names[0])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    expected = rows.where(f"opr_dt <> '{DAY}'").unionByName(month)
    columns = ["node", "opr_dt", "opr_hr", "mw"]
    again = spark.table(names[0]).select(*columns)
    assert again.exceptAll(expected).isEmpty() and again.count() == expected.count()


def test_a_table_that_would_lose_other_months_is_refused(spark, tmp_path, rows):
    table = f"plain_{tmp_path.name}"
    spark.sql(
        f"CREATE TABLE {table} ({bucketed.PRICE_COLUMNS}, year int, month int) USING parquet "
        f"PARTITIONED BY (year, month) CLUSTERED BY (node) INTO 4 BUCKETS LOCATION '{tmp_path}'"
    )
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        with pytest.raises(ValueError, match="dynamic"):
            bucketed.replace_months(rows, table)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        spark.sql(f"DROP TABLE {table}")
