"""Batch jobs that tie sources, operators and tables together.

Each job can be run again: finished days are skipped, and tables are written by
key or by whole partitions.
"""

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.periods import date_window, in_year
from hourgrid.operators.bx import (
    bx_daily,
    bx_zone_hourly,
    bx_zone_pooled,
    check_bx,
    missing_bx_dates,
    node_daily_summary,
    pending_bx,
)
from hourgrid.operators.cleaning import dedupe_keep_first
from hourgrid.operators.heatmaps import (
    PARTIAL_KEY,
    merged_partials,
    month_hour_heatmap,
    month_hour_partials,
)
from hourgrid.operators.rollups import annual_of_monthly, bx_monthly_sums
from hourgrid.operators.zones import mapping_stats, node_zone_map
from hourgrid.plans import ledger
from hourgrid.schemas import PRICE_SCHEMA
from hourgrid.session import Scratch, cut_lineage, write_and_read
from hourgrid.sources import archives, csv_files, paths, store
from hourgrid.sources.columns import typed_prices
from hourgrid.sources.csv_files import read_mapping

PRICE_KEY = ["node", "opr_dt", "opr_hr"]
BX_KEY = ["level", "node", "opr_dt", "bx_type"]


def all_bx(prices, mapping, bx_values=None):
    """Node, zone and overall daily Bx in one layout."""
    return bx_daily(prices, bx_values).unionByName(
        bx_zone_pooled(prices, mapping, bx_values), allowMissingColumns=True
    )


def store_bx(spark, prices, mapping, daily_path, bx_values=None):
    """Calculate and upsert the Bx of the given prices."""
    store.upsert_table(spark, daily_path, all_bx(prices, mapping, bx_values), BX_KEY, "opr_dt")


BATCH_FILES = 1000  # archives whose names the driver holds at a time


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def report_rows(rows, status):
    """Report rows of archives that were not read now."""
    nothing = F.lit(0).cast("long")
    return rows.select(
        F.col("file").alias("source_file"),
        nothing.alias("records"),
        F.lit(None).cast("string").alias("error"),
        nothing.alias("foreign_rows"),
        F.lit(status).alias("status"),
    )


def load_files(spark, files, content, store_path, daily_path=None, mapping=None, run=None):
    """Load some archives into the store and, optionally, the Bx of their days.

    ``files`` has file, length, modified and republished of each, ``content`` (path,
    content). An archive adds rows of its own day only; others are counted. A stored
    key stays as it is, unless the archive was loaded before and has been republished:
    its rows then replace those of the same key. Every archive gets a row in the
    ledger. Doing all of it again changes nothing.

    Returns the report, one staged row per archive.
    """
    with Scratch(spark, "load") as scratch:
        batch = scratch.stage(archives.unpack_archives(content), "unpacked")
        files = scratch.stage(files, "files")
        readable = batch.where(F.col("error").isNull()).withColumnRenamed("row_no", "row_id")
        rows = typed_prices(readable)
        own_day = F.col("opr_dt") == archives.archive_date(F.col("source_file"))
        foreign = rows.where(~own_day).groupBy("source_file").agg(
            F.count(F.lit(1)).alias("foreign_rows")
        )
        rows = rows.where(own_day)
        order = ["source_file", "row_id"]
        again = files.where("republished").select(F.col("file").alias("source_file"))
        fresh = rows.join(again, "source_file", "left_anti")
        store.append_prices(dedupe_keep_first(fresh, PRICE_KEY, order), store_path)
        if not again.isEmpty():
            newer = rows.join(again, "source_file", "left_semi")
            store.merge_daily(spark, dedupe_keep_first(newer, PRICE_KEY, order), store_path)
        if daily_path is not None:
            loaded = store.on_days(store.read_prices(spark, store_path), rows)
            store_bx(spark, loaded, mapping, daily_path)
        status = F.when(F.col("error").isNull(), ledger.PROCESSED).otherwise(ledger.ERROR)
        report = cut_lineage(
            archives.archive_status(batch)
            .join(foreign, "source_file", "left")
            .na.fill(0, ["foreign_rows"])
            .withColumn("status", status),
            "load-report",
        )
        results = report.select(F.col("source_file").alias("file"), "status", "error")
        known = files.select("file", "length", "modified")
        ledger.note(known.join(results, "file"), store_path, run)
    return report


def load_batch(
    spark,
    archive_path,
    store_path,
    daily_path=None,
    mapping=None,
    batch_size=None,
    year=None,
    max_attempts=None,
):
    """Load waiting archives, of one year if given, into the store and, optionally, their Bx.

    An archive waits until this version of it, by length and modification time, was
    loaded without an error. Those that failed least often come first, then by name, so
    an unreadable one never holds the others up; with ``max_attempts`` it is left alone
    after so many failures, until it is republished. See ``load_files`` for the rows.

    Returns one row per archive: processed, skipped, error, or quarantined. The driver
    holds the names of at most BATCH_FILES archives at a time; archive content is not
    read on it, and every archive is unzipped once.
    """
    recover(spark, store_path)
    run = uuid.uuid4().hex
    day = archives.archive_date(F.col("path"))
    files = (
        archives.list_archives(spark, archive_path)
        .select(F.col("file").alias("path"), "length", F.col("modificationTime").alias("modified"))
        .where(day.isNotNull() if year is None else F.year(day) == year)
        .withColumn("file", file_name(F.col("path")))
    )
    before = cut_lineage(ledger.states(files, ledger.read(spark, store_path)), "listing")
    loaded = before.where("loaded").select("file").distinct()
    reports = [report_rows(loaded, "skipped")]
    if max_attempts is not None:
        stuck = before.where(~F.col("loaded") & (F.col("attempts") >= max_attempts))
        reports.append(report_rows(stuck, "quarantined"))
    left = batch_size
    while left is None or left > 0:
        waiting = ledger.states(files, ledger.read(spark, store_path), run)
        waiting = waiting.where(~F.col("loaded") & ~F.col("tried"))
        if max_attempts is not None:
            waiting = waiting.where(F.col("attempts") < max_attempts)
        size = BATCH_FILES if left is None else min(left, BATCH_FILES)
        micros = F.unix_micros("modified").alias("micros")
        chosen = waiting.select("path", "file", "length", micros, "republished", "attempts")
        chosen = chosen.orderBy("attempts", "file", "path").limit(size).collect()
        if not chosen:
            break
        content = spark.read.format("binaryFile").load([row.path for row in chosen])
        some = spark.createDataFrame(
            [(r.file, r.length, r.micros, r.republished) for r in chosen],
            "file string, length long, micros long, republished boolean",
        ).withColumn("modified", F.timestamp_micros("micros"))
        reports.append(
            load_files(
                spark, some, content.select("path", "content"), store_path, daily_path, mapping, run
            )
        )
        left = None if left is None else left - len(chosen)
    return functools.reduce(DataFrame.unionByName, reports)


def load_summary(report):
    """Counts of a load report."""

    def files(status):
        return F.count(F.when(F.col("status") == status, 1))

    return report.agg(
        F.count(F.lit(1)).alias("total_files"),
        files("processed").alias("processed_files"),
        files("skipped").alias("skipped_files"),
        files("error").alias("error_files"),
        F.sum("records").alias("total_records"),
    )


def _journal(store_path, year):
    return f"{store_path}/_reprocess/{year}"


INTENT = "day date, action string"
REPLACE, DROP = "replace", "drop"


def _nothing(step):
    pass


def reprocess_year(spark, year, archive_path, store_path, batch_size=None, after_step=_nothing):
    """Load a year again from its archives, all batches of it, and replace it.

    1. All archives go to a store of their own below ``store_path``. One that cannot be
       read raises, and the stored year stays; so it does if the job breaks off here,
       and the next call goes on with the archives that are left.
    2. The days to replace and to drop are written down. From here on the year is
       replaced, by this call or, after a failure, by ``recover`` at the next start of
       any load.
    3. Each day is swapped by itself: its old folder goes, its new one is moved there.
       The new rows of a day exist at any time, and no step done twice does harm.
    4. Archives of dropped days are forgotten, those of the new days are remembered.

    ``after_step`` is called with the name of each finished step, for tests.
    Returns how many stored rows were replaced or dropped, and the load's report.
    """
    recover(spark, store_path, after_step)
    journal = _journal(store_path, year)
    fresh = f"{journal}/prices"
    _drop_stale(spark, archive_path, journal, fresh, year)
    reports = []
    while True:
        report = load_batch(spark, archive_path, fresh, batch_size=batch_size, year=year)
        report = cut_lineage(report)
        if not report.where("status = 'error'").isEmpty():
            raise ValueError(f"some archives of {year} cannot be read; nothing was replaced")
        loaded = report.where("status = 'processed'")
        if loaded.isEmpty():
            break
        reports.append(loaded)
        after_step("loaded")
    # Archives that an earlier, broken call has loaded are in the last report only.
    read = functools.reduce(DataFrame.unionByName, reports, report.limit(0))
    report = read.unionByName(report.join(read.select("source_file"), "source_file", "left_anti"))
    held = {d for d in store.list_day_folders(spark, store_path) if d.year == year}
    dropped = 0
    if held:
        stored = store.read_prices(spark, store_path)
        dropped = date_window(stored, f"{year}-01-01", f"{year}-12-31").count()
    new = set(store.list_day_folders(spark, fresh))
    intent = [(day, REPLACE if day in new else DROP) for day in sorted(held | new)]
    spark.createDataFrame(intent, INTENT).coalesce(1).write.parquet(f"{journal}/intent")
    after_step("intent")
    _replace_days(spark, store_path, journal, after_step)
    return dropped, report.withColumn("status", F.lit("processed"))


def _drop_stale(spark, archive_path, journal, fresh, year):
    """Begin anew if an archive that an earlier call has loaded is there no longer."""
    if not paths.exists(spark, journal):
        return
    names = archives.list_archives(spark, archive_path).select(file_name(F.col("file")).alias("file"))
    if not ledger.read(spark, fresh).join(names, "file", "left_anti").isEmpty():
        paths.drop_folder(spark, journal)


def _replace_days(spark, store_path, journal, after_step=_nothing):
    """Steps 3 and 4 of ``reprocess_year``, from wherever they were left."""
    fresh = f"{journal}/prices"
    intent = spark.read.schema(INTENT).parquet(f"{journal}/intent").orderBy("day").collect()
    staged = store.list_day_folders(spark, fresh)
    for day, action in intent:  # a year's days at most
        target = store.day_folder(store_path, day)
        if action == DROP:
            paths.drop_folder(spark, target)
        elif day in staged:
            paths.drop_folder(spark, target)
            after_step("cleared")
            paths.move_folder(spark, staged[day], target)
        after_step("day")
    done = spark.createDataFrame([(d,) for d, a in intent if a == DROP], "day date")
    known = ledger.read(spark, store_path).select("file").distinct()
    gone = known.join(done, archives.archive_date(F.col("file")) == F.col("day"), "left_semi")
    ledger.forget(cut_lineage(gone, "forgotten"), store_path, "reprocess")
    after_step("forgotten")
    loaded = ledger.read(spark, fresh).where(F.col("status") == ledger.PROCESSED)
    ledger.note(cut_lineage(loaded, "remembered"), store_path, "reprocess")
    after_step("remembered")
    paths.drop_folder(spark, journal)


def recover(spark, store_path, after_step=_nothing):
    """Finish what a broken ``reprocess_year`` had written down; other drafts stay."""
    for year in paths.list_hidden(spark, f"{store_path}/_reprocess"):
        journal = _journal(store_path, year)
        if paths.exists(spark, f"{journal}/intent/_SUCCESS"):
            _replace_days(spark, store_path, journal, after_step)
        elif paths.exists(spark, f"{journal}/intent"):
            paths.drop_folder(spark, f"{journal}/intent")


def clear_days(spark, store_path, start=None, end=None):
    """Drop the days of a range and forget their archives, so that they load again."""
    recover(spark, store_path)
    known = ledger.read(spark, store_path).select("file").distinct()
    days = known.withColumn("opr_dt", archives.archive_date(F.col("file")))
    files = cut_lineage(date_window(days, start, end).select("file"), "forgotten")
    dropped = store.clear_range(spark, store_path, start, end)
    ledger.forget(files, store_path, "clear")
    return dropped


def backfill_bx(spark, store_path, daily_path, mapping, year=None):
    """Calculate Bx for the stored days that have none."""
    days = in_year(store.stored_dates(spark, store_path), year)
    missing = missing_bx_dates(days, store.stored_days(spark, daily_path))
    prices = store.on_days(store.read_prices(spark, store_path), missing)
    store_bx(spark, prices, mapping, daily_path)


def calculate_bx(
    spark, store_path, daily_path, mapping, bx_values=None, start=None, end=None, force=False
):
    """Calculate chosen Bx of the stored days of a range; returns the (day, Bx) pairs done.

    Pairs that have rows stay, unless ``force``: then their rows go first, so that none
    stays that the prices no longer give. Only prices of days with such a pair are read,
    and only their partitions of the daily table are rewritten.
    """
    recover(spark, store_path)
    values = check_bx(bx_values)
    days = date_window(store.stored_dates(spark, store_path), start, end)
    with Scratch(spark, "bx") as scratch:
        if force:
            bx_type = F.explode(F.array(*[F.lit(v) for v in values])).alias("bx_type")
            wanted = days.select("opr_dt", bx_type)
        else:
            wanted = pending_bx(days, _calculated(spark, daily_path, days), values)
        wanted = cut_lineage(wanted, "bx-days")
        if wanted.isEmpty():
            return wanted
        prices = store.on_days(store.read_prices(spark, store_path), wanted)
        rows = all_bx(prices, mapping, values).join(wanted, ["opr_dt", "bx_type"], "left_semi")
        rows = scratch.stage(rows, "bx-rows")
        if force:
            store.replace_rows(spark, daily_path, wanted, rows, ["opr_dt", "bx_type"], "opr_dt")
        else:
            store.upsert_table(spark, daily_path, rows, BX_KEY, "opr_dt")
    return wanted


def _calculated(spark, daily_path, days):
    """The (day, Bx) pairs of the daily table that prices of ``days`` can have."""
    held = store.stored_days(spark, daily_path).join(days, "opr_dt", "left_semi")
    stored = [row.opr_dt for row in held.collect()]
    if not stored:
        return spark.createDataFrame([], "opr_dt date, bx_type int")
    daily = spark.read.parquet(daily_path).where(F.col("opr_dt").isin(stored))
    return daily.where("level = 'node'").select("opr_dt", "bx_type").distinct()


def rollup_job(spark, daily_path, monthly_path, annual_path, year=None):
    """Refresh the monthly and annual tables; the daily one is read once."""
    with Scratch(spark, "rollup") as scratch:
        sums = scratch.stage(bx_monthly_sums(spark.read.parquet(daily_path), year), "monthly")
        monthly = sums.drop("price_sum", "price_days")
        store.upsert_table(
            spark, monthly_path, monthly, ["node", "year_month", "bx_type"], "year_month"
        )
        annual = annual_of_monthly(sums)
        store.upsert_table(spark, annual_path, annual, ["node", "year", "bx_type"], "year")


def build_partials(spark, store_path, partials_path):
    """Store the month x hour partials of all prices, by year and month."""
    finish_days(spark, store_path, partials_path)
    _write_partials(month_hour_partials(store.read_prices(spark, store_path)), partials_path)


def _write_partials(partials, path):
    (
        partials.hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )


def _read_partials(spark, path, months):
    layout = "node string, hour int, price_sum decimal(38,4), price_count long, year int, month int"
    held = {
        (year, month)
        for year, month in months
        if paths.exists(spark, f"{path}/year={year}/month={month}")
    }
    if not held:
        return spark.createDataFrame([], layout).select(*PARTIAL_KEY, "price_sum", "price_count")
    chosen = functools.reduce(
        lambda a, b: a | b,
        [(F.col("year") == y) & (F.col("month") == m) for y, m in sorted(held)],
    )
    rows = spark.read.schema(layout).parquet(path).where(chosen)
    return rows.select(*PARTIAL_KEY, "price_sum", "price_count")


def replace_days(spark, rows, store_path, partials_path):
    """Replace whole days of the store, and their share in the month x hour partials.

    Read are ``rows``, the stored prices of the same days and the partials of their
    months. What the days held is subtracted, what they hold now is added. New prices
    and partials lie ready before the first old file goes; a job that broke off is
    finished by ``finish_days`` at the next start.
    """
    finish_days(spark, store_path, partials_path)
    journal = f"{store_path}/_days"
    rows = write_and_read(rows, f"{journal}/prices")
    days = rows.select("opr_dt").distinct()
    in_month = days.select(F.year("opr_dt").alias("y"), F.month("opr_dt").alias("m")).distinct()
    months = [tuple(row) for row in in_month.collect()]
    held = _read_partials(spark, partials_path, months)
    removed = month_hour_partials(rows.limit(0))
    if store.list_day_folders(spark, store_path):
        removed = month_hour_partials(store.on_days(store.read_prices(spark, store_path), rows))
    partials = merged_partials(held.unionByName(month_hour_partials(rows)), removed)
    partials.write.parquet(f"{journal}/partials")
    # A month whose prices all went has no cells, and its old ones must go.
    spark.createDataFrame(months, "year int, month int").write.parquet(f"{journal}/intent")
    finish_days(spark, store_path, partials_path)


def finish_days(spark, store_path, partials_path):
    """Apply what ``replace_days`` had made ready, or drop a draft."""
    journal = f"{store_path}/_days"
    if paths.exists(spark, f"{journal}/intent/_SUCCESS"):
        layout = f"{PRICE_SCHEMA.simpleString()[len('struct<'):-1]}".replace(":", " ")
        held = spark.read.parquet(f"{journal}/prices").columns
        prices = spark.read.schema(layout).parquet(f"{journal}/prices").select(
            *[name for name in PRICE_SCHEMA.fieldNames() if name in held]
        )
        store.write_daily(prices, store_path)
        partials = spark.read.parquet(f"{journal}/partials")
        _write_partials(partials, partials_path)
        months = spark.read.schema("year int, month int").parquet(f"{journal}/intent")
        empty = months.join(partials, ["year", "month"], "left_anti").collect()
        for year, month in empty:
            paths.drop_folder(spark, f"{partials_path}/year={year}/month={month}")
    paths.drop_folder(spark, journal)


def import_zone_files(spark, files, zone_path, daily_path):
    """Take published zone prices of any layout into the zone table, and their Bx.

    Files that are not there are skipped. Of several rows of one day, hour and zone the
    last one stays, by the order of ``files`` and within a file. Only the Bx of days in
    the files are calculated, from all stored hours of those days.
    """
    with Scratch(spark, "zones") as scratch:
        found = csv_files.read_zone_files(spark, files)
        if found is None:
            return 0
        key = ["opr_dt", "hour_num", "zone"]
        last = [F.desc(name) for name in ("file_no", "block", "line")]
        rows = dedupe_keep_first(found, key, last).drop("file_no", "block", "line")
        rows = scratch.stage(rows.withColumn("year", F.year("opr_dt")), "zone-hours")
        store.upsert_table(spark, zone_path, rows, key, "year")
        years = [row.year for row in rows.select("year").distinct().collect()]
        stored = spark.read.schema(rows.schema).parquet(zone_path).where(F.col("year").isin(years))
        days = rows.select("opr_dt").distinct()
        daily = bx_zone_hourly(stored.join(days, "opr_dt", "left_semi").drop("year"))
        store.upsert_table(spark, daily_path, daily, BX_KEY, "opr_dt")
        return rows.count()


def summarise_days(spark, store_path, summary_path, start=None, end=None):
    """Node-day summaries for the stored days that have none yet."""
    days = date_window(store.stored_dates(spark, store_path), start, end)
    missing = missing_bx_dates(days, store.stored_days(spark, summary_path))
    prices = store.on_days(store.read_prices(spark, store_path), missing)
    store.upsert_table(
        spark, summary_path, node_daily_summary(prices), ["node", "opr_dt"], "opr_dt"
    )


def refresh_heatmap(spark, store_path, mapping, heatmap_path, year):
    """Replace one year of the month x hour table; a year without prices goes."""
    cells = cut_lineage(month_hour_heatmap(store.read_prices(spark, store_path), mapping, year))
    if cells.isEmpty():
        paths.drop_folder(spark, f"{heatmap_path}/year={year}")
        return
    (
        cells.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(heatmap_path)
    )


def refresh_mapping(spark, zone_csv, node_csv, mapping_path):
    """Replace the mapping table from its two files; returns its statistics."""
    nodes, zones = read_mapping(spark, zone_csv, node_csv)
    store.replace_table(node_zone_map(nodes, zones), mapping_path)
    return mapping_stats(spark.read.parquet(mapping_path))
