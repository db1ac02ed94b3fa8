"""Tables that follow single days: partials, recalculated Bx, zone files, roll-ups."""

import datetime as dt
import random
import shutil
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import bx, heatmaps, rollups
from hourgrid.plans import jobs
from hourgrid.sources import csv_files, paths, store

SCHEMA = "node string, opr_dt date, opr_hr int, mw decimal(12,4)"


def prices(spark, days, nodes=("a", "b", "c"), hours=12, seed=1, first=dt.date(2024, 1, 30)):
    rng = random.Random(seed)
    rows = [
        (n, first + dt.timedelta(d), h, Decimal(rng.randrange(-500, 9000)) / 100)
        for d in days
        for n in nodes
        for h in range(1, hours + 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(
        [("a", "NP15"), ("b", "SP15"), ("d", None)], "pnode_id string, zone string"
    )


def cells(frame):
    return sorted(map(tuple, frame.select("zone", "year", "month", "hour", "avg_price", "record_count").collect()), key=repr)


def test_replaced_days_follow_in_the_partials(spark, tmp_path, zones):
    path, partials = str(tmp_path / "prices"), str(tmp_path / "partials")
    rows = prices(spark, range(6))
    store.write_daily(rows, path)
    jobs.build_partials(spark, path, partials)
    new = prices(spark, [1, 8], ("a", "c", "d"), 7, seed=2)
    # Only the day itself may be read: all other stored days are taken away.
    away = tmp_path / "away"
    for day, folder in store.list_day_folders(spark, path).items():
        if day != dt.date(2024, 1, 31):
            shutil.move(folder, away / day.isoformat())
    jobs.replace_days(spark, new, path, partials)
    kept = rows.where("opr_dt <> '2024-01-31'").unionByName(new)
    found = heatmaps.heatmap_of_partials(spark.read.parquet(partials), zones)
    assert cells(found) == cells(heatmaps.month_hour_heatmap(kept, zones))
    year = heatmaps.heatmap_of_partials(spark.read.parquet(partials), zones, 2023)
    assert year.isEmpty()
    assert not paths.exists(spark, f"{path}/_days")
    held = store.read_prices(spark, path).select("opr_dt").distinct().count()
    assert held == 2


def test_broken_replacements_are_finished_or_dropped(spark, tmp_path, zones, monkeypatch):
    path, partials = str(tmp_path / "prices"), str(tmp_path / "partials")
    rows, new = prices(spark, range(3)), prices(spark, [2], hours=5, seed=3)
    store.write_daily(rows, path)
    jobs.build_partials(spark, path, partials)
    before = cells(heatmaps.heatmap_of_partials(spark.read.parquet(partials), zones))
    after = rows.where("opr_dt <> '2024-02-01'").unionByName(new)
    after = cells(heatmaps.month_hour_heatmap(after, zones))

    def dies(*_):
        raise RuntimeError

    for name, owner in (("merged_partials", jobs), ("_write_partials", jobs)):
        with monkeypatch.context() as patch:
            patch.setattr(owner, name, dies)
            with pytest.raises(RuntimeError):
                jobs.replace_days(spark, new, path, partials)
        if name == "merged_partials":  # a draft
            jobs.finish_days(spark, path, partials)
            assert store.scan_day(spark, path, "2024-02-01").count() == 36
            found = heatmaps.heatmap_of_partials(spark.read.parquet(partials), zones)
            assert cells(found) == before
    jobs.finish_days(spark, path, partials)
    assert store.scan_day(spark, path, "2024-02-01").count() == 15
    found = heatmaps.heatmap_of_partials(spark.read.parquet(partials), zones)
    assert cells(found) == after


def files_of(folder):
    return {p.name for p in Path(folder).rglob("*.parquet")}


def pairs(frame):
    return sorted((r.opr_dt.isoformat(), r.bx_type) for r in frame.collect())


def test_missing_bx_are_added_and_forced_ones_replaced(spark, tmp_path, zones):
    path, daily = str(tmp_path / "prices"), str(tmp_path / "daily")
    store.write_daily(prices(spark, range(3)), path)
    first = jobs.calculate_bx(spark, path, daily, zones, [4], end="2024-01-31")
    assert pairs(first) == [("2024-01-30", 4), ("2024-01-31", 4)]
    old = files_of(f"{daily}/opr_dt=2024-01-30")
    done = jobs.calculate_bx(spark, path, daily, zones, [4, 5], start="2024-01-31")
    assert pairs(done) == [("2024-01-31", 5), ("2024-02-01", 4), ("2024-02-01", 5)]
    assert files_of(f"{daily}/opr_dt=2024-01-30") == old
    assert jobs.calculate_bx(spark, path, daily, zones, [4], end="2024-01-31").isEmpty()

    # Prices shrink: a node has no B5 any more, and a day has nothing at all.
    store.write_daily(prices(spark, [1], ("a",), hours=4, seed=9), path)
    store.write_daily(prices(spark, [2], ("a",), hours=2, seed=9), path)
    jobs.calculate_bx(spark, path, daily, zones, [4, 5], start="2024-01-31", force=True)
    rows = spark.read.parquet(daily).where("level = 'node'")
    held = {(r.node, r.opr_dt.isoformat(), r.bx_type) for r in rows.collect()}
    assert held == {("a", "2024-01-31", 4), *((n, "2024-01-30", 4) for n in "abc")}
    want = bx.bx_daily(store.scan_day(spark, path, "2024-01-31"), [4]).first().avg_price
    assert rows.where("opr_dt = '2024-01-31'").first().avg_price == want
    assert files_of(f"{daily}/opr_dt=2024-01-30") == old
    # A partition that loses its last row goes; the others keep their files.
    all_bx = spark.read.parquet(daily).where("opr_dt = '2024-02-01'").select("opr_dt", "bx_type")
    doomed = spark.createDataFrame(all_bx.distinct().collect(), all_bx.schema)
    nothing = spark.read.parquet(daily).limit(0)
    store.replace_rows(spark, daily, doomed, nothing, ["opr_dt", "bx_type"], "opr_dt")
    assert paths.list_folders(spark, daily) == ["opr_dt=2024-01-30", "opr_dt=2024-01-31"]


def test_annual_rollups_come_from_monthly_sums(spark):
    rng = random.Random(5)
    rows = [
        (n, dt.date(2023, 1, 1) + dt.timedelta(d), 4, Decimal(rng.randrange(-10**6, 10**6)) / 10000)
        for n in "ab"
        for d in range(0, 700, 3)
    ]
    daily = spark.createDataFrame(rows, "node string, opr_dt date, bx_type int, avg_price decimal(12,4)")
    for frame in (daily, daily.withColumn("avg_price", F.col("avg_price").cast("double"))):
        sums = rollups.bx_monthly_sums(frame)
        found = rollups.annual_of_monthly(sums).collect()
        want = rollups.bx_annual(frame).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, want))
        assert sorted(map(tuple, sums.drop("price_sum", "price_days").collect())) == sorted(
            map(tuple, rollups.bx_monthly(frame).collect())
        )


def test_zone_files_are_imported(spark, tmp_path):
    header = "Local Date,Hour Number,NP-15 LMP,SP-15 LMP"
    hours = "\n".join(f"2024-03-01,{h},{h},{10 * h}" for h in range(1, 5))
    (tmp_path / "one.csv").write_text(f"﻿title\n\n\n{header}\n{hours}\n2024-03-01,5,,7\nbad,6,1,1\n")
    (tmp_path / "two.csv").write_text(
        '"Hour Number","SP-15 LMP","Local Date"\n1,"99","03/01/2024"\n1,98,03/01/2024\n2,5,2024-03-02\n'
    )
    (tmp_path / "none.csv").write_text("no header here\n1,2,3\n")
    files = [str(tmp_path / f) for f in ("one.csv", "missing.csv", "none.csv", "two.csv")]
    table, daily = str(tmp_path / "hours"), str(tmp_path / "daily")
    assert jobs.import_zone_files(spark, files, table, daily) == 4 + 5 + 1
    held = {(r.opr_dt.day, r.hour_num, r.zone): float(r.lmp) for r in spark.read.parquet(table).collect()}
    assert held[1, 1, "SP15"] == 98 and held[1, 1, "NP15"] == 1 and held[2, 2, "SP15"] == 5
    assert held[1, 5, "SP15"] == 7 and (1, 5, "NP15") not in held and len(held) == 10
    rows = spark.read.parquet(daily).where("opr_dt = '2024-03-01'").collect()
    rows = {(r.node, r.bx_type): r.avg_price for r in rows}
    assert rows["NP15", 4] == Decimal("2.5") and rows["SP15", 4] == Decimal("24.25")
    assert rows["SP15", 5] == Decimal("39") and ("Overall", 5) in rows
    # In the other order the other file's row is the last.
    jobs.import_zone_files(spark, files[::-1], table, daily)
    row = spark.read.parquet(table).where("hour_num = 1 and zone = 'SP15'").first()
    assert row.lmp == 10
    assert jobs.import_zone_files(spark, [files[1]], table, daily) == 0
    with pytest.raises(ValueError):
        csv_files.read_zone_csv(spark, files[1])
