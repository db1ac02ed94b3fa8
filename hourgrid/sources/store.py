"""Partitioned Parquet tables: the day store of prices and the keyed summaries."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hourgrid.functions.filters import keep_nodes
from hourgrid.functions.periods import date_window
from hourgrid.operators.cleaning import (
    dedupe_keep_first,
    insert_ignore,
    upsert_keep_latest,
)
from hourgrid.schemas import PRICE_SCHEMA
from hourgrid.session import cut_lineage
from hourgrid.sources import paths

DAY_FOLDERS = ("year", "month", "opr_dt")
PRICE_COLUMNS = tuple(PRICE_SCHEMA.fieldNames())
PRICE_KEY = ["node", "opr_dt", "opr_hr"]
# Files are sorted by node; pages of a hundred node-days let a look-up of one node skip the
# others by their bounds, and a Bloom filter skips files without it where node names are too
# many for a dictionary. Its size follows the number of names.
LOOK_UP = {
    "parquet.page.row.count.limit": "2400",
    "parquet.bloom.filter.enabled#node": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def _price_layout(df):
    """The price schema in order, missing optional columns as NULL."""
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in PRICE_SCHEMA.fields
    ]
    return df.select(
        *columns, F.year("opr_dt").alias("year"), F.month("opr_dt").alias("month")
    )


def _write_days(df, path, mode):
    """Day folders with rows sorted by node.

    The rebalance gathers a day in as few files as the advisory size allows and
    splits a day that is larger than that over several tasks.
    """
    (
        _price_layout(df)
        .hint("rebalance", "opr_dt")
        .sortWithinPartitions(*DAY_FOLDERS, "node", "opr_hr")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .options(**LOOK_UP)
        .partitionBy(*DAY_FOLDERS)
        .parquet(path)
    )


def write_daily(df, path):
    """Replace the days present in ``df``; other days stay."""
    _write_days(df, path, "overwrite")


def append_prices(df, path):
    """Add the rows whose (node, opr_dt, opr_hr) is not stored yet; stored rows stay.

    ``df`` holds each key once. Stored files are not rewritten.
    """
    spark = df.sparkSession
    if list_day_folders(spark, path):
        df = insert_ignore(on_days(read_prices(spark, path), df), df, PRICE_KEY)
    _write_days(df, path, "append")


def merge_daily(spark, df, path):
    """Insert or replace single rows by (node, opr_dt, opr_hr).

    Only the days present in ``df`` are read and rewritten.
    """
    rows = df.select(*[c for c in PRICE_COLUMNS if c in df.columns])
    if list_day_folders(spark, path):
        old = on_days(read_prices(spark, path), rows)
        rows = cut_lineage(upsert_keep_latest(old, rows, ["node", "opr_dt", "opr_hr"]))
    write_daily(rows, path)


def on_days(prices, dates):
    """Prices of the days that occur in ``dates``.

    The days (one value each, so a calendar's worth at most) become a literal
    list, because only a literal filter prunes the folders of a plain scan.
    """
    days = [row.opr_dt for row in dates.select("opr_dt").distinct().collect()]
    return prices.where(F.col("opr_dt").isin(days))


def read_prices(spark, path):
    """The whole day store; filters on ``opr_dt`` prune folders."""
    schema = PRICE_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
    rows = spark.read.schema(f"{schema}, year int, month int").parquet(path)
    return rows.select(*PRICE_COLUMNS)


def scan_day(spark, path, day):
    return date_window(read_prices(spark, path), day, day)


def scan_range(spark, path, nodes=None, start=None, end=None):
    return keep_nodes(date_window(read_prices(spark, path), start, end), nodes)


def read_day_files(spark, path):
    """Foreign day files named by date, which hold node, mw and opr_hr only."""
    rows = (
        spark.read.schema("node string, mw double, opr_hr int")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )
    day = F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d{2}-\d{2})\.parquet$", 1)
    return rows.select(
        "node", "mw", "opr_hr", day.try_cast("date").alias("opr_dt")
    ).where(F.col("opr_dt").isNotNull())


def list_day_folders(spark, path):
    """Folder of every stored day; folder names only, no file is opened."""
    return {
        dt.date.fromisoformat(day.split("=")[1]): f"{path}/{year}/{month}/{day}"
        for year in paths.list_folders(spark, path)
        for month in paths.list_folders(spark, f"{path}/{year}")
        for day in paths.list_folders(spark, f"{path}/{year}/{month}")
    }


def day_folder(path, day):
    """Where the rows of a day lie."""
    return f"{path}/year={day.year}/month={day.month}/opr_dt={day.isoformat()}"


def stored_dates(spark, path):
    """The loaded days."""
    days = sorted(list_day_folders(spark, path))
    return spark.createDataFrame([(day,) for day in days], "opr_dt date")


def clear_range(spark, path, start=None, end=None):
    """Drop the day folders of a range and return how many rows they held.

    A date range is always whole folders, so nothing is rewritten. An unbounded
    delete is refused.
    """
    if start is None and end is None:
        raise ValueError("give a start or an end date")
    doomed = date_window(read_prices(spark, path), start, end).count()
    first = dt.date.min if start is None else dt.date.fromisoformat(str(start))
    last = dt.date.max if end is None else dt.date.fromisoformat(str(end))
    for day, folder in list_day_folders(spark, path).items():
        if first <= day <= last:
            paths.drop_folder(spark, folder)
    return doomed


def clear_year(spark, path, year):
    return clear_range(spark, path, dt.date(year, 1, 1), dt.date(year, 12, 31))


def _write_table(df, path, partition, mode):
    (
        df.hint("rebalance", partition)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def stored_days(spark, path):
    """Days of a summary table that is partitioned by day."""
    names = [name.split("=")[1] for name in paths.list_folders(spark, path)]
    return spark.createDataFrame([(dt.date.fromisoformat(n),) for n in names], "opr_dt date")


def _touched(spark, path, named, partition, new=None):
    """The stored rows in the partitions that ``named`` falls into, or None.

    Partition values are few and become literals, so other folders are not read.
    Stored columns that ``new`` (``named`` itself, if not given) lacks are read as well;
    they are looked up in the files of these partitions only.
    """
    new = named if new is None else new
    stored = {name.split("=")[1] for name in paths.list_folders(spark, path)}
    values = [row[0] for row in named.select(partition).distinct().collect()]
    shared = [value for value in values if str(value) in stored]
    if not shared:
        return None
    own = {f.name: f for f in new.schema.fields}
    folders = [f"{path}/{partition}={value}" for value in shared]
    touched = spark.read.option("mergeSchema", True).option("basePath", path)
    held = touched.parquet(*folders).schema.fields
    schema = StructType([*own.values(), *[f for f in held if f.name not in own]])
    return spark.read.schema(schema).parquet(path).where(F.col(partition).isin(shared))


def upsert_table(spark, path, new, keys, partition):
    """Insert or replace rows by key, rewriting only the partitions they touch.

    ``new`` holds each key once. Its rows are kept in the shared folder, since
    they are read twice; merged partitions are cut from their inputs before the
    write replaces those. New partitions are written without a merge.
    """
    rows = cut_lineage(new)
    old = _touched(spark, path, rows, partition)
    if old is not None:
        rows = cut_lineage(upsert_keep_latest(old, rows, keys))
    _write_table(rows, path, partition, "overwrite")


def replace_rows(spark, path, doomed, new, on, partition):
    """Delete the rows whose ``on`` columns occur in ``doomed`` and insert ``new`` ones.

    Only partitions named in ``doomed`` are read and rewritten, as one copy; one that is
    left without a row goes.
    """
    rows = cut_lineage(new)
    old = _touched(spark, path, doomed, partition, rows)
    merged = rows
    if old is not None:
        kept = old.join(doomed.select(*on).distinct(), list(on), "left_anti")
        merged = cut_lineage(kept.unionByName(rows, allowMissingColumns=True))
    _write_table(merged, path, partition, "overwrite")
    left = {str(row[0]) for row in merged.select(partition).distinct().collect()}
    named = {str(row[0]) for row in doomed.select(partition).distinct().collect()}
    for name in paths.list_folders(spark, path):
        value = name.split("=")[1]
        if value in named - left:
            paths.drop_folder(spark, f"{path}/{name}")


def insert_ignore_table(spark, path, new, keys, partition):
    """Append the rows whose key is not stored yet."""
    order = [c for c in sorted(new.columns) if c not in keys]
    rows = cut_lineage(dedupe_keep_first(new, keys, order))
    old = _touched(spark, path, rows, partition)
    if old is not None:
        rows = insert_ignore(old, rows, keys)
    _write_table(rows, path, partition, "append")


def replace_partitions(df, path, partition):
    """Replace the partitions present in ``df``; others stay."""
    _write_table(df, path, partition, "overwrite")


def replace_table(df, path):
    """Full refresh of a small table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
