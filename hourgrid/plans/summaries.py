"""Jobs that keep small tables beside the prices, so that later answers need no prices.

Each job takes the days it is given and touches the rows of these days only; the same days
again change nothing.
"""

import datetime as dt

from pyspark.sql import functions as F

from hourgrid.functions.sketches import day_sketches
from hourgrid.operators.bx_sums import bx_sums
from hourgrid.operators.spikes import spikes_after
from hourgrid.session import Scratch
from hourgrid.sources import node_index, paths, store

STATES = 8  # states of past days that a correction can go back to
TAIL = "node string, opr_dt date, opr_hr int, mw decimal(12,4)"
SPIKES = (
    "operational_hour int, node string, mw double, rolling_mean double, operational_date date"
)


def keep_sketches(spark, prices, path):
    """Replace the quantile sketches of the days present in ``prices``."""
    store.replace_partitions(day_sketches(prices), path, "opr_dt")


def keep_bx_sums(spark, daily, mapping, index_path, path):
    """Replace the Bx sums of the days present in ``daily``, numbering new nodes first."""
    rows = daily.where(F.col("level") == "node") if "level" in daily.columns else daily
    with Scratch(spark, "sums") as scratch:
        # Read twice, for the numbers and for the sums; ranks are too dear for that.
        staged = scratch.stage(rows.select("node", "opr_dt", "bx_type", "avg_price"))
        node_index.update_nodes(spark, index_path, staged)
        sums = bx_sums(staged, node_index.read_nodes(spark, index_path), mapping)
        store.replace_partitions(sums, path, "opr_dt")


def _days(spark, path):
    names = [name.split("=")[1] for name in paths.list_folders(spark, path) if "=" in name]
    return sorted(dt.date.fromisoformat(name) for name in names)


def append_spikes(spark, prices, path, threshold_std=3, exclude_zero=True):
    """Add the spikes of new days, reading these days and 23 stored rows of each node.

    ``path`` holds the spikes by day and, per call, the state behind its last day. Whatever
    is stored from the first day of ``prices`` on is replaced, so a corrected day comes
    with those after it; it may lie back as far as the last ``STATES`` calls, or else all
    days come again. The state is written last: a call that failed is made again.
    """
    with Scratch(spark, "spikes") as scratch:
        # The new days are read by several windows and are made once.
        new = scratch.stage(prices.select("node", "opr_dt", "opr_hr", "mw"), "new")
        _append_spikes(spark, scratch, new, path, threshold_std, exclude_zero)


def _append_spikes(spark, scratch, prices, path, threshold_std, exclude_zero):
    bounds = prices.agg(F.min("opr_dt").alias("first"), F.max("opr_dt").alias("last")).first()
    if bounds.first is None:
        return
    found, states = f"{path}/spikes", f"{path}/states"
    stored = _days(spark, states)
    before = [day for day in stored if day < bounds.first]
    tails = spark.createDataFrame([], TAIL)
    if before:
        tails = spark.read.schema(TAIL).parquet(f"{states}/upto={before[-1]}")
    else:
        begun = _days(spark, f"{path}/begun")
        if begun and begun[-1] < bounds.first:
            raise ValueError(f"no state before {bounds.first} is kept; append all days again")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/begun/day={bounds.first}")
        for day in begun:
            if day != bounds.first:
                paths.drop_folder(spark, f"{path}/begun/day={day}")
    for folder, label, days in (
        (states, "upto", stored),
        (found, "operational_date", _days(spark, found)),
    ):
        for day in days:
            if day >= bounds.first:
                paths.drop_folder(spark, f"{folder}/{label}={day}")
    new, left = spikes_after(tails, prices, threshold_std, exclude_zero)
    # Few rows, written once, since the day folders are cut from them.
    store.replace_partitions(scratch.stage(new), found, "operational_date")
    left.write.parquet(f"{states}/upto={bounds.last}")
    for day in before[: 1 - STATES]:
        paths.drop_folder(spark, f"{states}/upto={day}")


def read_spikes(spark, path):
    """All stored spikes."""
    if not paths.list_folders(spark, f"{path}/spikes"):
        return spark.createDataFrame([], SPIKES)
    return spark.read.schema(SPIKES).parquet(f"{path}/spikes")
