"""Loads that lose and block nothing: bad and republished archives, broken jobs, streams."""

import os

import pytest
from test_sources import archive, days, keys, line

from hourgrid.plans import jobs, ledger
from hourgrid.sources import paths, store
from hourgrid.streaming import ingest


class Stopped(Exception):
    pass


def break_archive(folder, day):
    stamp = day.replace("-", "")
    path = folder / f"{stamp}_{stamp}_DAM_LMP_GRP_N_N_v12_csv.zip"
    path.write_bytes(b"no zip")
    return path


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    days(folder, 3, hours=4)
    break_archive(folder, "2024-02-01")
    return folder


def statuses(report):
    return sorted((r.source_file[4:8], r.status) for r in report.collect())


def test_a_bad_archive_holds_nothing_up(spark, tmp_path, landing):
    path = str(tmp_path / "prices")
    first = [statuses(jobs.load_batch(spark, str(landing), path, batch_size=1)) for _ in range(5)]
    assert first[0] == [("0201", "error")]
    assert first[1] == [("0301", "processed")]
    assert first[3][-1] == ("0303", "processed") and ("0301", "skipped") in first[3]
    assert first[4] == [
        ("0201", "error"), ("0301", "skipped"), ("0302", "skipped"), ("0303", "skipped"),
    ]
    failed = ledger.failed_archives(spark, path).collect()
    assert [(r.file[4:8], r.attempts) for r in failed] == [("0201", 2)] and failed[0].error
    stuck = jobs.load_batch(spark, str(landing), path, max_attempts=2)
    assert ("0201", "quarantined") in statuses(stuck)
    archive(landing, "2024-02-01", [line("2024-02-01", h, "a", 1) for h in (1, 2)])
    mended = jobs.load_batch(spark, str(landing), path, max_attempts=2)
    assert ("0201", "processed") in statuses(mended)
    assert ledger.failed_archives(spark, path).isEmpty()
    assert store.read_prices(spark, path).count() == 24 + 2


def test_a_republished_archive_replaces_its_rows(spark, tmp_path, landing):
    path, daily = str(tmp_path / "prices"), str(tmp_path / "daily")
    zones = spark.createDataFrame([("a", "NP15")], "pnode_id string, zone string")
    jobs.load_batch(spark, str(landing), path, daily, zones)
    rows = [line("2024-03-02", 1, "a", 777), line("2024-03-02", 5, "a", 5)]
    changed = archive(landing, "2024-03-02", rows)
    os.utime(changed, (1_700_000_000, 1_700_000_000))
    report = jobs.load_batch(spark, str(landing), path, daily, zones)
    assert ("0302", "processed") in statuses(report) and ("0301", "skipped") in statuses(report)
    held = {(r.node, r.opr_hr): r.mw for r in store.scan_day(spark, path, "2024-03-02").collect()}
    assert held["a", 1] == 777 and held["a", 5] == 5 and held["a", 2] == 22 and len(held) == 9
    bx = spark.read.parquet(daily).where("opr_dt = '2024-03-02' and level = 'node' and node = 'a'")
    assert {r.bx_type for r in bx.collect()} == {4, 5}
    assert ("0302", "skipped") in statuses(jobs.load_batch(spark, str(landing), path))


def test_ledgers_of_names_only_are_understood(spark, tmp_path, landing):
    path = str(tmp_path / "prices")
    names = [(p.name,) for p in landing.iterdir() if "20240301" in p.name]
    spark.createDataFrame(names, "file string").write.parquet(f"{path}/_loaded")
    report = statuses(jobs.load_batch(spark, str(landing), path))
    assert ("0301", "skipped") in report and ("0302", "processed") in report


def test_cleared_days_load_again(spark, tmp_path, landing):
    path = str(tmp_path / "prices")
    jobs.load_batch(spark, str(landing), path)
    before = keys(store.read_prices(spark, path))
    assert jobs.clear_days(spark, path, "2024-03-02", "2024-03-03") == 16
    assert store.read_prices(spark, path).count() == 8
    report = statuses(jobs.load_batch(spark, str(landing), path))
    assert ("0301", "skipped") in report and ("0303", "processed") in report
    assert keys(store.read_prices(spark, path)) == before


def names(spark, landing, path, **options):
    steps = []
    jobs.reprocess_year(spark, 2024, str(landing), path, after_step=steps.append, **options)
    return steps


def test_a_year_survives_a_failure_after_any_step(spark, tmp_path):
    landing, other = tmp_path / "landing", tmp_path / "other"
    for folder in (landing, other):
        folder.mkdir()
    days(landing, 3, hours=2)
    archive(landing, "2023-12-31", [line("2023-12-31", 1, "a", 9)])
    archive(other, "2024-03-01", [line("2024-03-01", 1, "a", 50)])
    archive(other, "2024-03-04", [line("2024-03-04", 1, "a", 60)])
    whole = str(tmp_path / "whole")
    jobs.load_batch(spark, str(landing), whole)
    old = keys(store.read_prices(spark, whole))
    steps = names(spark, other, whole, batch_size=1)
    assert steps == ["loaded", "loaded", "intent", "cleared", "day", "day", "day", "cleared",
                     "day", "forgotten", "remembered"]
    new = keys(store.read_prices(spark, whole))
    assert [r[1].isoformat() for r in new] == ["2023-12-31", "2024-03-01", "2024-03-04"]
    assert not paths.exists(spark, f"{whole}/_reprocess/2024")

    for number in (0, 2, 3, 4, 9, 10):  # each kind of step
        path = str(tmp_path / f"prices-{number}")
        jobs.load_batch(spark, str(landing), path)
        seen = []

        def stop(step):
            seen.append(step)
            if len(seen) > number:
                raise Stopped

        with pytest.raises(Stopped):
            jobs.reprocess_year(spark, 2024, str(other), path, 1, after_step=stop)
        if number == 0:  # nothing is decided yet: the old year is whole, and the job goes on
            assert keys(store.read_prices(spark, path)) == old
            jobs.reprocess_year(spark, 2024, str(other), path)
        elif number % 2:
            jobs.recover(spark, path)
        else:
            jobs.load_batch(spark, str(other), path)
        assert keys(store.read_prices(spark, path)) == new
        assert not paths.exists(spark, f"{path}/_reprocess/2024")
    # The archives of days that went are waiting again, the others are not.
    report = dict(statuses(jobs.load_batch(spark, str(landing), path)))
    assert report["0302"] == "processed" and report["1231"] == "skipped"


def test_bad_archives_leave_the_year_and_the_next_call_goes_on(spark, tmp_path, landing):
    path = str(tmp_path / "prices")
    jobs.load_batch(spark, str(landing), path)
    old = keys(store.read_prices(spark, path))
    with pytest.raises(ValueError):
        jobs.reprocess_year(spark, 2024, str(landing), path)
    assert keys(store.read_prices(spark, path)) == old
    archive(landing, "2024-02-01", [line("2024-02-01", 1, "a", 1)])
    dropped, report = jobs.reprocess_year(spark, 2024, str(landing), path)
    assert dropped == len(old) and report.count() == 4
    assert store.read_prices(spark, path).count() == len(old) + 1


def test_a_stream_equals_the_batch_load(spark, tmp_path, landing):
    zones = spark.createDataFrame([("a", "NP15")], "pnode_id string, zone string")
    base = str(tmp_path)

    def run():
        files = ingest.archive_files(spark, str(landing), max_files=2)
        ingest.stream_archives(
            files, f"{base}/prices", f"{base}/progress", "s", f"{base}/daily", zones, f"{base}/reports"
        ).awaitTermination()

    run()
    archive(landing, "2024-03-04", [line("2024-03-04", h, n, h) for n in "ab" for h in range(1, 5)])
    archive(landing, "2024-03-05", [line("2024-03-05", 1, "a", 3), line("2024-03-01", 1, "a", 0)])
    run()
    twin = str(tmp_path / "twin")
    jobs.load_batch(spark, str(landing), twin, f"{twin}-daily", zones)
    assert keys(store.read_prices(spark, f"{base}/prices")) == keys(store.read_prices(spark, twin))
    daily, other = (spark.read.parquet(p) for p in (f"{base}/daily", f"{twin}-daily"))
    assert daily.exceptAll(other.select(daily.columns)).isEmpty() and daily.count() == other.count()
    report = spark.read.parquet(f"{base}/reports")
    status = {(r.source_file[4:8], r.status) for r in report.collect()}
    assert ("0201", "error") in status and ("0305", "processed") in status
    assert report.where("foreign_rows = 1").count() == 1
    # What the stream has loaded does not wait for the batch load.
    assert {s for _, s in statuses(jobs.load_batch(spark, str(landing), f"{base}/prices"))} == {
        "skipped", "error",
    }


def test_a_replayed_batch_changes_nothing(spark, tmp_path, landing):
    """The second run of a micro-batch reports and stores what the first one did."""
    path = str(tmp_path / "prices")

    def run(progress):
        files = ingest.archive_files(spark, str(landing), max_files=9)
        ingest.stream_archives(
            files, path, str(tmp_path / progress), "s", report_path=str(tmp_path / "reports")
        ).awaitTermination()
        report = spark.read.parquet(str(tmp_path / "reports"))
        return statuses(report), keys(store.read_prices(spark, path))

    assert run("one") == run("two")  # batch 0 again, as after a lost checkpoint


def test_stored_keys_stay_in_a_row_stream(spark, tmp_path):
    rows = spark.sql("select 'a' node, date'2024-01-01' opr_dt, 1 opr_hr, cast(5 as decimal(12,4)) mw")
    path = str(tmp_path / "prices")
    store.write_daily(rows, path)
    other = spark.sql("select 'a' node, date'2024-01-01' opr_dt, h opr_hr, cast(3 as decimal(12,4)) mw from values 1, 2 v(h)")
    other.write.parquet(str(tmp_path / "landing"))
    stream = ingest.parquet_stream(spark, str(tmp_path / "landing"), other.schema)
    ingest.stream_daily_ingest(stream, path, str(tmp_path / "c")).awaitTermination()
    assert [(r.opr_hr, r.mw) for r in store.read_prices(spark, path).orderBy("opr_hr").collect()] == [(1, 5), (2, 3)]
