import datetime as dt
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import cleaning
from hourgrid.plans import jobs
from hourgrid.sources import archives, columns, csv_files, store
from hourgrid.streaming import ingest

HEADER = "INTERVALSTARTTIME_GMT,OPR_DT,OPR_HR,NODE_ID,NODE,MW,MCC"


def line(day, hour, node, price):
    return f"{day}T08:00:00-00:00,{day},{hour},{node}_id,{node},{price},0.5"


def archive(folder, day, rows, header=HEADER, member="PRC_LMP_DAM_LMP", extra=()):
    stamp = day.replace("-", "")
    path = folder / f"{stamp}_{stamp}_DAM_LMP_GRP_N_N_v12_csv.zip"
    with zipfile.ZipFile(path, "w") as out:
        for name, text in extra:
            out.writestr(name, text)
        out.writestr(f"{stamp}_{member}_DAM_v12.csv", "\n".join([header, *rows]) + "\n")
    return path


def days(folder, count=4, hours=12):
    for number in range(1, count + 1):
        day = f"2024-03-{number:02d}"
        rows = [line(day, h, n, 10 * number + h) for n in ("a", "b") for h in range(1, hours + 1)]
        archive(folder, day, rows)


def keys(frame):
    return sorted((r.node, r.opr_dt, r.opr_hr, r.mw) for r in frame.collect())


def test_bad_values_are_dropped(spark, tmp_path):
    rows = [
        line("2024-03-01", " 07 ", " a ", " 1.25 "),
        line("2024-03-01", "5.0", "a", 1),
        line("2024-03-01", 8, "a", "abc"),
        line("2024-03-01", 9, "a", ""),
        line("2024-03-01", 10, "a", "NaN"),
        line("2024-03-01", 11, "a", "inf"),
        line("", 12, "a", 3),
        line("03/01/2024", 13, "a", 3),
        line("2024-03-01", 14, "", 3),
        "2024-03-01T08:00:00-00:00,2024-03-01",
        line("2024-03-01", 15, "a", "1e2") + ",surplus",
    ]
    archive(tmp_path, "2024-03-01", rows)
    frame = archives.ingest_zip(archives.read_archives(spark, str(tmp_path)))
    day = dt.date(2024, 3, 1)
    assert keys(frame) == [("a", day, 7, Decimal("1.25")), ("a", day, 15, Decimal("100"))]


def test_headers_in_any_case(spark, tmp_path):
    archive(tmp_path, "2024-03-01", ["2024-03-01,1,x,5"], "opr_dt,opr_hr,pnode_resmrid,mw")
    frame = archives.ingest_zip(archives.read_archives(spark, str(tmp_path)))
    assert [r.node for r in frame.collect()] == ["x"]


def test_first_price_member_is_taken(spark, tmp_path):
    other = [("readme_PRC_LMP_DAM_LMP.txt", "x"), ("PRC_MCC.csv", "a,b\n1,2\n")]
    archive(tmp_path, "2024-03-01", [line("2024-03-01", 1, "a", 5)], extra=other)
    frame = archives.ingest_zip(archives.read_archives(spark, str(tmp_path)))
    assert frame.count() == 1


def test_load_is_resumable_and_survives_bad_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    days(landing)
    (landing / "20240305_20240305_DAM_LMP_GRP.zip").write_bytes(b"not a zip")
    archive(landing, "2024-03-06", ["1,2"], header="A,B")
    archive(landing, "2024-03-07", [line("2024-03-07", "x", "a", 1)])
    (landing / "20240308_other.zip").write_bytes(b"ignored")
    paths = str(landing), str(tmp_path / "prices"), str(tmp_path / "daily")
    zones = spark.createDataFrame([("a", "NP15")], "pnode_id string, zone string")

    first = jobs.load_batch(spark, *paths, zones, batch_size=2)
    assert {r.source_file[:8]: r.status for r in first.collect()} == {
        "20240301": "processed",
        "20240302": "processed",
    }
    second = jobs.load_batch(spark, *paths, zones)
    status = {r.source_file[:8]: (r.status, r.records) for r in second.collect()}
    assert status == {
        "20240301": ("skipped", 0),
        "20240302": ("skipped", 0),
        "20240303": ("processed", 24),
        "20240304": ("processed", 24),
        "20240305": ("error", 0),
        "20240306": ("error", 0),
        "20240307": ("error", 0),
    }
    counts = jobs.load_summary(second).first()
    assert (counts.processed_files, counts.skipped_files, counts.error_files) == (2, 2, 3)
    assert counts.total_records == 48
    stored = keys(store.read_prices(spark, paths[1]))
    daily = spark.read.parquet(paths[2])
    assert len(stored) == 96 and daily.where("level = 'node'").count() == 4 * 2 * 7
    assert daily.where("level = 'zone'").count() == daily.where("level = 'overall'").count() == 28

    jobs.load_batch(spark, *paths, zones)
    assert keys(store.read_prices(spark, paths[1])) == stored
    assert spark.read.parquet(paths[2]).count() == 4 * 4 * 7


def test_duplicate_rows_keep_the_first(spark, tmp_path):
    rows = [line("2024-03-01", 1, "a", p) for p in (5, 6, 7)]
    archive(tmp_path, "2024-03-01", rows)
    jobs.load_batch(spark, str(tmp_path), str(tmp_path / "prices"))
    assert [r.mw for r in store.read_prices(spark, str(tmp_path / "prices")).collect()] == [5]


def test_reprocess_year(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "prices")
    landing.mkdir()
    days(landing, 2)
    jobs.load_batch(spark, str(landing), path)
    days(landing, 1, hours=6)
    dropped, _ = jobs.reprocess_year(spark, 2024, str(landing), path)
    assert dropped == 48 and store.read_prices(spark, path).count() == 12 + 24


def test_streaming_twin(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    days(landing, 3)
    base = str(tmp_path)
    zones = spark.createDataFrame([("a", "NP15")], "pnode_id string, zone string")

    def run():
        rows = ingest.archive_stream(spark, str(landing), max_files=2)
        ingest.stream_daily_ingest(
            rows, f"{base}/prices", f"{base}/progress", f"{base}/daily", zones
        ).awaitTermination()
        return keys(store.read_prices(spark, f"{base}/prices"))

    assert len(run()) == 72
    days(landing, 4)
    assert len(run()) == 96
    assert spark.read.parquet(f"{base}/daily").where("level = 'node'").count() == 4 * 2 * 7


def price_rows(spark, numbers, first=dt.date(2023, 12, 30), nodes=("a", "b")):
    rows = [
        (n, Decimal(i), first + dt.timedelta(i), h)
        for i in numbers
        for n in nodes
        for h in (1, 2)
    ]
    return spark.createDataFrame(rows, "node string, mw decimal(12,4), opr_dt date, opr_hr int")


def test_day_store(spark, tmp_path):
    path = str(tmp_path / "prices")
    store.write_daily(price_rows(spark, range(4)), path)
    store.write_daily(price_rows(spark, [3], nodes=("z",)), path)
    assert {r.node for r in store.scan_day(spark, path, dt.date(2024, 1, 2)).collect()} == {"z"}
    assert store.read_prices(spark, path).count() == 14
    store.append_prices(price_rows(spark, [3]), path)
    assert store.scan_day(spark, path, dt.date(2024, 1, 2)).count() == 6
    assert [r.opr_dt.day for r in store.stored_dates(spark, path).collect()] == [30, 31, 1, 2]
    window = store.scan_range(spark, path, "a", dt.date(2023, 12, 31), dt.date(2024, 1, 1))
    assert window.count() == 4
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(opr_dt" in plan and "EqualTo(node,a)" in plan


def test_merge_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "prices")
    store.write_daily(price_rows(spark, range(3)), path)
    untouched = sorted(p.name for p in (tmp_path / "prices").rglob("opr_dt=2023-12-30/*.parquet"))
    new = price_rows(spark, [2], nodes=("b", "c")).selectExpr("node", "mw + 5 AS mw", "opr_dt", "opr_hr")
    store.merge_daily(spark, new, path)
    found = {(r.node, r.opr_hr): r.mw for r in store.scan_day(spark, path, dt.date(2024, 1, 1)).collect()}
    assert found == {("a", 1): 2, ("a", 2): 2, ("b", 1): 7, ("b", 2): 7, ("c", 1): 7, ("c", 2): 7}
    assert untouched == sorted(
        p.name for p in (tmp_path / "prices").rglob("opr_dt=2023-12-30/*.parquet")
    )


def test_clear_range(spark, tmp_path):
    path = str(tmp_path / "prices")
    store.write_daily(price_rows(spark, range(4)), path)
    with pytest.raises(ValueError):
        store.clear_range(spark, path)
    with pytest.raises(ValueError):
        cleaning.delete_range(price_rows(spark, [1]))
    assert store.clear_range(spark, path, end="2023-12-31") == 8
    assert store.clear_year(spark, path, 2024) == 8
    assert store.stored_dates(spark, path).count() == 0


def test_foreign_day_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "year=2024" / "month=01"
    folder.mkdir(parents=True)
    table = pa.table(
        {"node": ["a"], "mw": [1.5], "opr_hr": pa.array([3], pa.int32())}
    )
    pq.write_table(table, folder / "2024-01-05.parquet")
    pq.write_table(table, folder / "notes.parquet")
    row, = store.read_day_files(spark, str(tmp_path)).collect()
    assert (row.node, row.mw, row.opr_hr, row.opr_dt) == ("a", 1.5, 3, dt.date(2024, 1, 5))


def test_strict_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Opr_Dt,OPR_HR,pnode_x,MW\n2024-01-01,2,a,5\n2024-01-01,2,a,6\n")
    row, = csv_files.load_price_csv(spark, str(tmp_path / "p.csv")).collect()
    assert (row.node, row.mw, row.source_file) == ("a", 5, "p.csv")
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        csv_files.load_price_csv(spark, str(tmp_path / "q.csv"))


def test_generic_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text(
        "IntervalStartTime_GMT,Node_ID,Node,MW,Energy Loss,Weekday Pos,Opr_Dt,Opr_Hr\n"
        "2024-01-01 05:00:00,i,a,10001,1,2,2024-01-01,2\n"
        "2024-01-01 05:00:00,i,a,-1001,1,2,2024-01-01,3\n"
        "2024-01-01 05:00:00,i,a,10000,x,2,2024-01-01,4\n"
        "2024-01-01 05:00:00,i,a,7,1,2,2024-01-01,4\n"
        "2024-01-01 05:00:00,i,b,7,1,2,2024-01-01,4\n"
    )
    frame = csv_files.standardize_csv(csv_files.read_text_csv(spark, str(tmp_path / "g.csv")))
    assert "NODE_ID" not in frame.columns and "DAY_OF_WEEK" not in frame.columns
    rows = csv_files.to_price_table(frame).collect()
    assert [(r.node, r.opr_hr, r.mw, r.mlc) for r in rows] == [("a", 4, 10000, None), ("b", 4, 7, 1)]
    with pytest.raises(ValueError):
        csv_files.standardize_csv(frame.select("NODE"))


def test_duplicate_headers_keep_the_first(spark):
    frame = spark.createDataFrame([("1", "2", "3")], ["MW", "Price", "Node"])
    assert columns.standardize_columns(frame).first().asDict() == {"MW": "1", "NODE": "3"}


def test_format_check():
    assert columns.validate_format(["IntervalStartTime_x", "node", "MW"])
    assert not columns.validate_format(["node", "MW"])


def test_mapping_files(spark, tmp_path):
    zone_file, node_file = tmp_path / "zones.csv", tmp_path / "nodes.csv"
    zone_file.write_bytes(
        "﻿Resource ID,Matched Zone,Local Area,Generator Name\n"
        "r1,NP15,x,g1\nr2,Not found,x,g2\n".encode("utf-8")
    )
    node_file.write_text("PNODE_ID,RES_ID\nn1,r1\nn1,r1\nn2,r2\nn3,r9\n")
    path = str(tmp_path / "mapping")
    for _ in range(2):
        row = jobs.refresh_mapping(spark, str(zone_file), str(node_file), path).first()
    assert (row.total_mappings, row.unique_zones, row.unmapped_nodes) == (3, 1, 2)


def test_zone_files_of_different_layouts(spark, tmp_path):
    (tmp_path / "2020.csv").write_text(
        "title\n\nnote,with,commas\n"
        "Local Date,Hour Number,NP-15 LMP,NP-15 (Congestion),SP-15 LMP,ZP-26 LMP\n"
        "01/02/2020,1,10.5,0.1,11,12\n01/02/2020,2,20.5,,21,22\n"
    )
    (tmp_path / "2021.csv").write_text(
        "title\n\nnote\n"
        "Local Date,Hour Number,ZP-26 LMP,SP-15 LMP,NP-15 LMP,NP-15 (Loss)\n"
        "2021-03-04,24,3,2,1,-0.25\n"
    )
    rows = csv_files.read_zone_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 9
    found = {(r.opr_dt, r.hour_num, r.zone): r for r in rows}
    first = found[dt.date(2020, 1, 2), 1, "NP15"]
    assert (float(first.lmp), float(first.congestion), first.loss) == (10.5, 0.1, None)
    last = found[dt.date(2021, 3, 4), 24, "NP15"]
    assert (float(last.lmp), last.congestion, float(last.loss)) == (1, None, -0.25)


def test_summaries_skip_finished_days(spark, tmp_path):
    prices, out = str(tmp_path / "prices"), str(tmp_path / "summary")
    store.write_daily(price_rows(spark, range(2)), prices)
    jobs.summarise_days(spark, prices, out)
    store.write_daily(price_rows(spark, [1, 2], nodes=("a", "b", "c")), prices)
    jobs.summarise_days(spark, prices, out)
    found = {r.opr_dt: r["count"] for r in spark.read.parquet(out).groupBy("opr_dt").count().collect()}
    assert list(dict(sorted(found.items())).values()) == [2, 2, 3]


def test_upsert_twice_is_the_same(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = price_rows(spark, range(3)).selectExpr("node", "opr_dt", "opr_hr", "mw")
    for _ in range(2):
        store.upsert_table(spark, path, rows, ["node", "opr_dt", "opr_hr"], "opr_dt")
        store.insert_ignore_table(spark, path, rows, ["node", "opr_dt", "opr_hr"], "opr_dt")
    assert keys(spark.read.parquet(path)) == keys(rows)


def test_rows_of_another_day_and_second_archives(spark, tmp_path):
    """An archive adds rows of its own day only; the result is the same for any batch size."""
    landing = tmp_path / "landing"
    landing.mkdir()
    first = [line("2024-03-01", h, "a", 1) for h in range(1, 25)]
    stray = [line("2024-03-01", 3, "a", 9), line("2024-03-03", 1, "a", 9)]
    archive(landing, "2024-03-01", first)
    archive(landing, "2024-03-02", [line("2024-03-02", 1, "a", 2), *stray])
    archive(landing, "2024-03-03", [line("2024-03-03", h, "a", 3) for h in (1, 2)])
    results = []
    for size in (1, 2, None):
        path = str(tmp_path / f"prices-{size}")
        reports = []
        for _ in range(4):
            reports += jobs.load_batch(spark, str(landing), path, batch_size=size).collect()
        results.append(
            sorted((r.opr_dt, r.opr_hr, r.mw) for r in store.read_prices(spark, path).collect())
        )
        done = [r for r in reports if r.status == "processed"]
        assert len(done) == 3 and sum(r.foreign_rows for r in done) == 2
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 24 + 1 + 2 and (dt.date(2024, 3, 1), 3, 9) not in results[0]


def test_reprocess_in_batches_keeps_other_years(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "prices")
    landing.mkdir()
    days(landing, 3)
    store.write_daily(price_rows(spark, [0], first=dt.date(2023, 5, 1)), path)
    jobs.load_batch(spark, str(landing), path)
    dropped, _ = jobs.reprocess_year(spark, 2024, str(landing), path, batch_size=1)
    assert dropped == 72 and store.read_prices(spark, path).count() == 72 + 4


def test_append_keeps_stored_keys_and_upsert_keeps_columns(spark, tmp_path):
    path = str(tmp_path / "prices")
    store.append_prices(price_rows(spark, [0]), path)
    store.append_prices(price_rows(spark, [0]).withColumn("mw", F.lit(7)), path)
    assert {r.mw for r in store.read_prices(spark, path).collect()} == {0}
    table = str(tmp_path / "table")
    schema = "node string, opr_dt date, v int, extra string"
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([("a", day, 1, "x"), ("b", day, 1, "y")], schema)
    store.upsert_table(spark, table, old, ["node"], "opr_dt")
    store.upsert_table(spark, table, old.where("node = 'a'").drop("extra"), ["node"], "opr_dt")
    rows = {r.node: r.extra for r in spark.read.parquet(table).collect()}
    assert rows == {"a": None, "b": "y"}
