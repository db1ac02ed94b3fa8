"""Averages, trends and roll-ups of daily Bx."""

from pyspark.sql import functions as F

from hourgrid.functions.filters import keep_nodes
from hourgrid.functions.periods import date_window, in_month, in_year, period_start
from hourgrid.functions.rounding import round_to
from hourgrid.operators.bx import (
    _bx_of_hourly,
    bx_daily,
    check_bx,
    common_bx_hours,
    hourly_zone_means,
)
from hourgrid.operators.zones import zone_filtered
from hourgrid.schemas import OVERALL


def _select_daily(daily, bx, start, end, zone, nodes, mapping):
    rows = daily.where(F.col("bx_type") == check_bx([bx])[0])
    if "level" in daily.columns:
        rows = rows.where(F.col("level") == "node")
    rows = keep_nodes(date_window(rows, start, end), nodes)
    if zone is not None:
        if mapping is None:
            raise ValueError("a zone filter needs the node mapping")
        rows = zone_filtered(rows, mapping, zone)
    return rows


def _bx_stats():
    return [
        F.avg("avg_price").alias("avg_bx_price"),
        F.min("avg_price").alias("min_bx_price"),
        F.max("avg_price").alias("max_bx_price"),
    ]


def bx_average(daily, bx, start=None, end=None, zone=None, nodes=None, mapping=None):
    """One row: average, range and coverage of a node-level Bx."""
    return _select_daily(daily, bx, start, end, zone, nodes, mapping).agg(
        F.lit(bx).alias("bx_type"),
        *_bx_stats(),
        F.countDistinct("node").alias("node_count"),
        F.countDistinct("opr_dt").alias("day_count"),
    )


def bx_trend(
    daily, bx, start=None, end=None, zone=None, nodes=None, aggregation="daily", mapping=None
):
    """Average Bx over the nodes per day, week or month."""
    return (
        _select_daily(daily, bx, start, end, zone, nodes, mapping)
        .groupBy(period_start("opr_dt", aggregation).alias("period"))
        .agg(
            F.avg("avg_price").alias("avg_price"),
            F.countDistinct("node").alias("node_count"),
        )
        .orderBy("period")
    )


def _rollup(rows, period, *more):
    return rows.groupBy("node", period, "bx_type").agg(
        round_to(F.avg("avg_price"), 2).alias("avg_price"),
        round_to(F.min("avg_price"), 2).alias("min_price"),
        round_to(F.max("avg_price"), 2).alias("max_price"),
        F.countDistinct("opr_dt").alias("day_count"),
        *more,
    )


def _node_level(daily):
    return daily.where(F.col("level") == "node") if "level" in daily.columns else daily


def bx_monthly(daily, year=None, month=None):
    """Node x month x bx."""
    rows = _node_level(daily)
    if year is not None and month is not None:
        rows = in_month(rows, year, month)
    else:
        rows = in_year(rows, year)
        if month is not None:
            rows = rows.where(F.month("opr_dt") == month)
    return _rollup(rows, F.date_format("opr_dt", "yyyy-MM").alias("year_month"))


def bx_monthly_sums(daily, year=None):
    """``bx_monthly`` with the exact sum of the days, which adds up over months."""
    rows = in_year(_node_level(daily), year)
    return _rollup(
        rows,
        F.date_format("opr_dt", "yyyy-MM").alias("year_month"),
        F.sum("avg_price").alias("price_sum"),
        F.count("avg_price").alias("price_days"),
    )


def annual_of_monthly(sums):
    """``bx_annual`` from ``bx_monthly_sums``: months share no day, so counts add up.

    The mean has the scale that an average of stored prices has before it is rounded.
    """
    mean = F.sum("price_sum") / F.sum("price_days")
    if dict(sums.dtypes)["price_sum"].startswith("decimal"):
        mean = mean.cast("decimal(20,8)")
    year = F.left("year_month", F.lit(4)).cast("int").alias("year")
    return sums.groupBy("node", year, "bx_type").agg(
        round_to(mean, 2).alias("avg_price"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.sum("day_count").alias("day_count"),
    )


def bx_annual(daily, year=None):
    """Node x year x bx."""
    return _rollup(in_year(_node_level(daily), year), F.year("opr_dt").alias("year"))


def bx_annual_average(annual, bx, year=None, zone=None, nodes=None, mapping=None):
    """One row for a year (the latest by default) from the annual table."""
    rows = annual.where(F.col("bx_type") == check_bx([bx])[0])
    if year is not None:
        rows = rows.where(F.col("year") == year)
    rows = keep_nodes(rows, nodes)
    if zone is not None:
        if mapping is None:
            raise ValueError("a zone filter needs the node mapping")
        rows = zone_filtered(rows, mapping, zone)
    return (
        rows.groupBy("year")
        .agg(
            F.lit(bx).alias("bx_type"),
            F.avg("avg_price").alias("avg_bx_price"),
            F.min("min_price").alias("min_bx_price"),
            F.max("max_price").alias("max_bx_price"),
            F.countDistinct("node").alias("node_count"),
            F.sum("day_count").alias("_days"),
        )
        .withColumn("avg_days", F.expr("_days div node_count"))
        .drop("_days")
        .orderBy(F.col("year").desc())
        .limit(1)
    )


def _zone_level(daily, bx):
    return daily.where(
        (F.col("bx_type") == check_bx([bx])[0]) & F.col("level").isin("zone", "overall")
    )


def _chosen(rows, year, month, start, end):
    """Rows of a date range, open at a side without a bound, or else of a month or year."""
    if start is not None or end is not None:
        return date_window(rows, start, end)
    if month is None:
        return in_year(rows, year)
    if year is None:
        raise ValueError("a month needs its year")
    return in_month(rows, year, month)


def zone_bx_average(zone_daily, bx, year=None, month=None, start=None, end=None):
    """Bx statistics of every zone and Overall for a year, month or date range."""
    rows = _chosen(_zone_level(zone_daily, bx), year, month, start, end)
    return (
        rows.groupBy(F.col("node").alias("zone"))
        .agg(*_bx_stats(), F.count(F.lit(1)).alias("day_count"))
        .orderBy("zone")
    )


def zone_bx_from_raw(prices, mapping, bx, year=None, start=None, end=None):
    """The same statistics straight from prices, ranking hourly zone averages."""
    rows = _chosen(prices, year, None, start, end)
    return (
        _bx_of_hourly(hourly_zone_means(rows, mapping), check_bx([bx]))
        .withColumnRenamed("_avg", "avg_price")
        .groupBy("zone")
        .agg(*_bx_stats(), F.count(F.lit(1)).alias("day_count"))
        .orderBy("zone")
    )


def bx_trend_by_zone(zone_daily, bx, year, aggregation="monthly"):
    """Bx per period for every zone and Overall."""
    return (
        in_year(_zone_level(zone_daily, bx), year)
        .groupBy(
            F.col("node").alias("zone"),
            period_start("opr_dt", aggregation).alias("period"),
        )
        .agg(
            F.avg("avg_price").alias("avg_price"), F.count(F.lit(1)).alias("day_count")
        )
        .orderBy("zone", "period")
    )


def _node_bx(prices, bx, nodes, year):
    """Unstored daily Bx of chosen nodes in one year."""
    return bx_daily(keep_nodes(in_year(prices, year), nodes), [bx], stored=False)


def bx_trend_per_node(prices, bx, nodes, year, aggregation="monthly"):
    """Bx per node and period, straight from prices."""
    return (
        _node_bx(prices, bx, nodes, year)
        .groupBy("node", period_start("opr_dt", aggregation).alias("period"))
        .agg(F.avg("avg_price").alias("avg_price"))
        .orderBy("node", "period")
    )


def node_bx_stats(prices, bx, nodes=None, year=None):
    """Average Bx, day count and usual cheap hours of each node."""
    rows = keep_nodes(in_year(prices, year), nodes)
    return (
        bx_daily(rows, [bx], stored=False)
        .groupBy("node")
        .agg(
            F.avg("avg_price").alias("avg_price"), F.count(F.lit(1)).alias("day_count")
        )
        .join(common_bx_hours(rows, bx).select("node", "hours_text"), "node", "left")
        .withColumnRenamed("hours_text", "common_hours")
        .orderBy("avg_price", "node")
    )


def node_bx_overall(prices, bx, nodes=None, year=None):
    """One row over all node-days of the chosen nodes."""
    return _node_bx(prices, bx, nodes, year).agg(
        F.lit(bx).alias("bx_type"),
        *_bx_stats(),
        F.countDistinct("node").alias("node_count"),
        F.countDistinct("opr_dt").alias("day_count"),
    )


def bx_box_stats(prices, bx, nodes=None, year=None):
    """Box-plot statistics of the daily Bx of each node within a year.

    A node has one value per day of the year, so the exact percentile's value
    map holds at most 366 entries per node and year.
    """
    if year is None:
        raise ValueError("box statistics are computed for one year")
    quartiles = F.percentile("avg_price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        _node_bx(prices, bx, nodes, year)
        .groupBy("node")
        .agg(
            F.avg("avg_price").alias("mean"),
            F.min("avg_price").alias("min"),
            F.max("avg_price").alias("max"),
            quartiles.alias("_q"),
            F.count(F.lit(1)).alias("day_count"),
        )
        .select(
            "node",
            "mean",
            "min",
            "max",
            F.col("_q")[0].alias("q1"),
            F.col("_q")[1].alias("median"),
            F.col("_q")[2].alias("q3"),
            "day_count",
        )
        .orderBy("mean", "node")
    )


def zone_comparison(zone_daily, bx, year=None, month=None):
    """Average Bx of the zones only."""
    return (
        zone_bx_average(zone_daily, bx, year, month)
        .where(F.col("zone") != OVERALL)
        .select("zone", F.col("avg_bx_price").alias("avg_price"))
    )
