"""Node numbers, Bx sums, sketches and spikes kept beside the prices."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hourgrid.functions import sketches
from hourgrid.operators import bx, bx_sums, nodes, rollups, spikes
from hourgrid.plans import summaries
from hourgrid.plans.catalog import QUERIES
from hourgrid.sources import node_index, paths

SCHEMA = "node string, opr_dt date, opr_hr int, mw decimal(12,4)"
FIRST = dt.date(2024, 1, 25)


def prices(spark, days, names, hours=8, seed=1):
    rng = random.Random(seed)
    rows = [
        (n, FIRST + dt.timedelta(d), h, Decimal(rng.choice([rng.randrange(-300, 3000), 90000])) / 100)
        for d in days
        for n in names
        for h in range(1, hours + 1)
        if rng.random() < 0.9
    ]
    return spark.createDataFrame(rows, SCHEMA)


def table(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_node_numbers_last_and_are_unique(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [f"N_{i:04d}" for i in range(0, 900, 2)]
    later = [f"N_{i:04d}" for i in range(0, 900)] + ["N%x", "ab"]
    assert node_index.read_nodes(spark, path).isEmpty()
    node_index.update_nodes(spark, path, prices(spark, [3], first, 1))
    one = {r.node: r for r in node_index.read_nodes(spark, path).collect()}
    for _ in range(3):
        node_index.update_nodes(spark, path, prices(spark, [0, 5], later, 2, seed=2))
    two = {r.node: r for r in node_index.read_nodes(spark, path).collect()}
    assert {n: r.node_id for n, r in one.items()} == {n: two[n].node_id for n in one}
    numbers = [r.node_id for r in two.values()]
    assert len(set(numbers)) == len(numbers) and min(numbers) >= 1
    assert max(numbers) <= node_index.LANES * 16
    both = [n for n in one if two[n].first_day == FIRST and two[n].last_day == FIRST + dt.timedelta(5)]
    assert len(both) > 300
    assert len(paths.list_folders(spark, path)) == 2


def test_found_nodes_are_those_found_in_prices(spark, tmp_path):
    path = str(tmp_path / "index")
    names = ["ALPHA_7_N001", "alpha_7", "BETA%1", "BETA_1", "x", "aaaa", "aaab", "ÄTNA_1", "back\\s"]
    rows = prices(spark, range(3), names)
    node_index.update_nodes(spark, path, rows)
    for term in ("pha_7", "a_7", "%1", "beta%", "aaa", "aaaa", "ätn", "x", "", "k\\s", "zzz", "BETA_1"):
        assert table(node_index.find_nodes(spark, path, term)) == table(nodes.search_nodes(rows, term))
    assert [r.node for r in node_index.stored_nodes(spark, path, limit=2).collect()] == [
        r.node for r in nodes.all_nodes(rows, 2).collect()
    ]


def test_missing_index_falls_back_to_the_mapping(spark, tmp_path, mapping):
    zones = mapping([("b", "NP15"), ("a", None), ("b", "SP15")])
    found = node_index.stored_nodes(spark, str(tmp_path / "none"), zones)
    assert [r.node for r in found.collect()] == ["a", "b"]
    assert node_index.stored_nodes(spark, str(tmp_path / "none")).isEmpty()
    assert node_index.find_nodes(spark, str(tmp_path / "none"), "abc").isEmpty()


def test_sums_answer_like_the_daily_table(spark, tmp_path, mapping):
    index, path = str(tmp_path / "index"), str(tmp_path / "sums")
    names = [f"n{i}" for i in range(12)]
    zones = mapping([(n, ("NP15", "SP15", None)[i % 3]) for i, n in enumerate(names)])
    old, new = prices(spark, range(6), names[:8]), prices(spark, range(4, 12), names[3:], seed=5)
    kept = old.where(F.col("opr_dt") < FIRST + dt.timedelta(4)).unionByName(new)
    for part in (old, new, new):
        summaries.keep_bx_sums(spark, bx.bx_daily(part), zones, index, path)
    sums, daily = spark.read.parquet(path), bx.bx_daily(kept)
    for choice in ({}, {"zone": "SP15"}, {"start": dt.date(2024, 2, 1)}, {"start": dt.date(2030, 1, 1)}):
        expected = rollups.bx_average(daily, 5, mapping=zones, **choice)
        assert table(bx_sums.average_of_sums(sums, 5, **choice)) == table(expected)
        for period in ("daily", "weekly", "monthly"):
            expected = rollups.bx_trend(daily, 5, mapping=zones, aggregation=period, **choice)
            assert table(bx_sums.trend_of_sums(sums, 5, aggregation=period, **choice)) == table(expected)
    plan = bx_sums.average_of_sums(sums, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    unknown = spark.createDataFrame([], "node string, node_id long")
    with pytest.raises(Exception, match="no number for node"):
        bx_sums.bx_sums(daily, unknown).collect()


def test_blocks_of_node_numbers_add_up(spark):
    rows = spark.range(1, 70001).select(
        F.concat(F.lit("n"), "id").alias("node"),
        F.lit(FIRST).alias("opr_dt"),
        F.lit(4).alias("bx_type"),
        F.col("id").cast("decimal(12,4)").alias("avg_price"),
    )
    numbers = spark.range(1, 70001).select(F.concat(F.lit("n"), "id").alias("node"), F.col("id").alias("node_id"))
    sums = bx_sums.bx_sums(rows, numbers)
    assert sums.count() == 3
    found = bx_sums.average_of_sums(sums, 4).first()
    assert (found.node_count, found.day_count, found.max_bx_price) == (70000, 1, 70000)


def test_sketches_stay_within_the_bound(spark):
    rows = spark.range(200000).select(
        F.concat(F.lit("n"), F.col("id") % 3).alias("node"),
        F.date_add(F.lit(FIRST), (F.col("id") / 3 / 24).cast("int") % 1000).alias("opr_dt"),
        ((F.col("id") * 7919) % 200000 / 100).cast("decimal(12,4)").alias("mw"),
    )
    kept = sketches.day_sketches(rows)
    fractions = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    got = sketches.sketch_profile(kept, [], fractions).first()
    assert (got["count"], got["min"], got["max"]) == (200000, 0.0, 1999.99)
    assert got["avg"] == pytest.approx(999.995)
    for name, fraction in fractions.items():
        assert abs(got[name] / 2000 - fraction) <= sketches.RANK_ERROR
    days = sketches.sketch_profile(kept, ["node", "opr_dt"], {"p50": 0.5})
    exact = rows.groupBy("node", "opr_dt").agg(F.count("mw").alias("n"), F.min("mw").alias("lo"))
    both = days.join(exact, ["node", "opr_dt"])
    assert both.where("count <> n OR min <> lo").isEmpty() and both.count() == kept.count()
    nothing = sketches.sketch_profile(kept.where("false"), [], {"p50": 0.5}).first()
    assert (nothing["count"], nothing["p50"]) == (0, None)


def test_spikes_day_by_day_equal_those_of_all_days(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "spikes")
    monkeypatch.setattr(summaries, "STATES", 3)
    rows = prices(spark, range(20), ["a", "b"]).unionByName(prices(spark, range(9, 20), ["late"], seed=3))

    def days(first, last):
        start = FIRST + dt.timedelta(first)
        return rows.where(F.col("opr_dt").between(start, FIRST + dt.timedelta(last)))

    def same(until):
        expected = spikes.price_spikes(days(0, until), threshold_std=1.5)
        columns = expected.columns
        return table(summaries.read_spikes(spark, path).select(columns)) == table(expected)

    assert summaries.read_spikes(spark, path).isEmpty()
    for first, last in ((0, 2), (3, 3), (4, 9), (10, 14), (15, 16), (10, 19), (19, 19)):
        summaries.append_spikes(spark, days(first, last), path, threshold_std=1.5)
        assert same(last)
    summaries.append_spikes(spark, rows.where("false"), path, threshold_std=1.5)
    assert same(19)
    with pytest.raises(ValueError, match="append all days"):
        summaries.append_spikes(spark, days(2, 19), path, threshold_std=1.5)
    summaries.append_spikes(spark, days(0, 19), path, threshold_std=1.5)
    assert same(19)


def counted(spark, frame):
    """``frame`` with a counter of how many rows all its readers made it compute."""
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(passed, frame.schema), made


def test_new_days_are_computed_once_for_spikes(spark, tmp_path):
    rows, made = counted(spark, prices(spark, range(12), ["a", "b"]))
    summaries.append_spikes(spark, rows, str(tmp_path / "spikes"), threshold_std=1.5)
    assert made.value == prices(spark, range(12), ["a", "b"]).count()


def test_a_sparse_series_is_copied_less_than_once(spark):
    rows = spark.range(60 * 6).selectExpr(
        "'a' AS node",
        "add_months(DATE '2020-01-01', CAST(id DIV 6 AS INT)) AS opr_dt",
        "CAST(id % 6 * 4 + 1 AS INT) AS opr_hr",
        "CAST(id * 7919 % 101 AS DECIMAL(12,4)) AS mw",
    )
    parts = spikes._with_history(rows, 23)
    assert parts.where("_own").count() == 360 and parts.count() < 720
    found = spikes.price_spikes(rows, threshold_std=1.5)
    ordered = [(r.opr_dt, r.opr_hr, float(r.mw)) for r in rows.orderBy("opr_dt", "opr_hr").collect()]
    expected = set()
    for i, (day, hour, price) in enumerate(ordered):
        if price > 0:
            frame = [p for _, _, p in ordered[: i + 1] if p > 0][-24:]
            if len(frame) > 1:
                mean = sum(frame) / len(frame)
                deviation = (sum((p - mean) ** 2 for p in frame) / (len(frame) - 1)) ** 0.5
                if deviation > 0 and price > mean + 1.5 * deviation:
                    expected.add((day, hour))
    assert expected and {(r.operational_date, r.operational_hour) for r in found.collect()} == expected


def test_daily_bx_is_computed_once_for_sums(spark, tmp_path, mapping):
    daily = bx.bx_daily(prices(spark, range(4), ["a", "b"]))
    rows, made = counted(spark, daily)
    zones = mapping([("a", "NP15")])
    summaries.keep_bx_sums(spark, rows, zones, str(tmp_path / "index"), str(tmp_path / "sums"))
    assert made.value == daily.count()


def test_ranks_of_all_nodes_need_no_copy_of_prices(spark, tmp_path):
    tables = {
        "region": [("r_regionkey int, r_name string"), [(0, "AFRICA")]],
        "nation": [("n_nationkey int, n_name string, n_regionkey int"), [(0, "N", 0)]],
        "supplier": [
            ("s_suppkey long, s_name string, s_nationkey int"),
            [(i, f"Supplier#{i:09d}", 0) for i in range(3)],
        ],
        "lineitem": [
            (
                "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                "l_shipdate timestamp"
            ),
            [
                (i, i % 3, 1, float(i * 7919 % 10007), dt.datetime(1994 + i % 3, 1 + i % 12, 5))
                for i in range(3000)
            ],
        ],
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    result = QUERIES["price_quantile_sketches"](spark, str(tmp_path))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
    rows = {r.node: r for r in result.collect()}
    assert len(rows) == 4 and all(r.within_bound for r in rows.values())
    assert rows["all nodes"]["count"] == sum(r["count"] for n, r in rows.items() if n != "all nodes")
