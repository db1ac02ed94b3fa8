"""Sums of daily Bx that merge over any range, with bit maps of the nodes.

One row per day, Bx, zone and block of 32,768 node numbers stands for all its nodes. Sums
and counts add up, and bit maps are joined by OR, so averages and exact numbers of
distinct nodes of any range come from these few rows: no daily row is read, and no
distinct count spreads the input over several groupings.
"""

from pyspark.sql import functions as F

from hourgrid.functions.periods import date_window, period_start
from hourgrid.operators.bx import check_bx
from hourgrid.operators.zones import attach_zone

KEY = ["opr_dt", "bx_type", "zone", "node_block"]


def bx_sums(daily, numbers, mapping=None):
    """``daily`` node Bx summed up; ``numbers`` has (node, node_id) of every node.

    A node without a number is an error. Without a mapping the zone is NULL.
    """
    rows = daily.where(F.col("level") == "node") if "level" in daily.columns else daily
    rows = rows.select("node", "opr_dt", "bx_type", "avg_price")
    unknown = F.raise_error(F.concat(F.lit("no number for node "), F.col("node")))
    rows = rows.join(numbers.select("node", "node_id"), "node", "left").withColumn(
        "node_id", F.coalesce("node_id", unknown.cast("long"))
    )
    if mapping is None:
        rows = rows.withColumn("zone", F.lit(None).cast("string"))
    else:
        rows = attach_zone(rows, mapping)
    return rows.groupBy(
        "opr_dt", "bx_type", "zone", F.bitmap_bucket_number("node_id").alias("node_block")
    ).agg(
        F.sum("avg_price").alias("price_sum"),
        F.count("avg_price").alias("price_count"),
        F.min("avg_price").alias("min_price"),
        F.max("avg_price").alias("max_price"),
        F.bitmap_construct_agg(F.bitmap_bit_position("node_id")).alias("nodes"),
    )


def _chosen(sums, bx, start, end, zone):
    rows = sums.where(F.col("bx_type") == check_bx([bx])[0])
    if zone is not None:
        rows = rows.where(F.col("zone") == zone)
    return date_window(rows, start, end)


def _mean(sums, total, count):
    """Exact sums divided once, with the scale that an average of stored prices has."""
    if dict(sums.dtypes)[total].startswith("decimal"):
        return (F.sum(total).cast("decimal(24,4)") / F.sum(count)).cast("decimal(20,8)")
    return F.sum(total) / F.sum(count)


def average_of_sums(sums, bx, start=None, end=None, zone=None):
    """``bx_average`` from the sums."""
    rows = _chosen(sums, bx, start, end, zone)
    blocks = rows.groupBy("node_block").agg(F.bitmap_count(F.bitmap_or_agg("nodes")).alias("_n"))
    day = F.datediff("opr_dt", F.lit("1900-01-01").cast("date")).cast("long")
    days = rows.groupBy(F.bitmap_bucket_number(day).alias("_block")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(day))).alias("_n")
    )
    nothing = F.lit(0).cast("long")
    return rows.agg(
        F.lit(bx).alias("bx_type"),
        _mean(sums, "price_sum", "price_count").alias("avg_bx_price"),
        F.min("min_price").alias("min_bx_price"),
        F.max("max_price").alias("max_bx_price"),
    ).select(
        "*",
        F.coalesce(blocks.agg(F.sum("_n")).scalar(), nothing).alias("node_count"),
        F.coalesce(days.agg(F.sum("_n")).scalar(), nothing).alias("day_count"),
    )


def trend_of_sums(sums, bx, start=None, end=None, zone=None, aggregation="daily"):
    """``bx_trend`` from the sums."""
    return (
        _chosen(sums, bx, start, end, zone)
        .groupBy(period_start("opr_dt", aggregation).alias("period"), "node_block")
        .agg(
            F.sum("price_sum").alias("price_sum"),
            F.sum("price_count").alias("price_count"),
            F.bitmap_count(F.bitmap_or_agg("nodes")).alias("_nodes"),
        )
        .groupBy("period")
        .agg(
            _mean(sums, "price_sum", "price_count").alias("avg_price"),
            F.sum("_nodes").alias("node_count"),
        )
        .orderBy("period")
    )
