"""Bx: the average of the x cheapest hours of a day, x from 4 to 10.

A node-day's hours are ranked by price (the lower hour wins a tie). Running
aggregates along that rank give every Bx at once: the running average at rank x
is Bx. So one shuffle and one sort serve all seven values, and because only
ranks up to ten matter, Spark drops the dearer hours before the shuffle.
"""

from pyspark.sql import Window, functions as F

from hourgrid.functions.rounding import as_price
from hourgrid.operators.zones import attach_zone, zone_and_overall
from hourgrid.schemas import BX_VALUES, HOURS, OVERALL


def check_bx(bx_values):
    values = sorted(set(bx_values or BX_VALUES))
    for value in values:
        if value not in BX_VALUES:
            raise ValueError(
                f"BX must be between {BX_VALUES[0]} and {BX_VALUES[-1]}, got {value}"
            )
    return values


def _by_price(keys, price="mw", hour="opr_hr"):
    return Window.partitionBy(*keys).orderBy(price, hour)


def rank_hours(df, keys=("node", "opr_dt"), price="mw", hour="opr_hr", keep=BX_VALUES[-1]):
    """The ``keep`` cheapest hours of each group with their rank."""
    return (
        df.where(F.col(price).isNotNull())
        .withColumn("hour_rank", F.row_number().over(_by_price(keys, price, hour)))
        .where(F.col("hour_rank") <= keep)
    )


def _running(df, keys, price, hour, keep):
    """Cheapest ``keep`` ranks with running average and hour range up to each."""
    upto = _by_price(keys, price, hour).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.where(F.col(price).isNotNull())
        .select(
            *keys,
            F.row_number().over(_by_price(keys, price, hour)).alias("bx_type"),
            F.avg(price).over(upto).alias("_avg"),
            F.min(hour).over(upto).alias("min_hour"),
            F.max(hour).over(upto).alias("max_hour"),
        )
        .where(F.col("bx_type") <= keep)
    )


def bx_daily(df, bx_values=None, stored=True):
    """Bx of every node-day; a day with fewer than x hours has no Bx row.

    ``stored`` rounds the average to the four decimals of the daily table.
    """
    values = check_bx(bx_values)
    average = as_price("_avg") if stored else F.col("_avg")
    return (
        _running(df, ["node", "opr_dt"], "mw", "opr_hr", values[-1])
        .where(F.col("bx_type").isin(values))
        .select(
            F.lit("node").alias("level"),
            "node",
            "opr_dt",
            "bx_type",
            average.alias("avg_price"),
            "min_hour",
            "max_hour",
        )
    )


def _bx_at_or_above(rank, values):
    """The Bx values that include an hour of this rank."""
    return F.filter(F.array(*[F.lit(v) for v in values]), lambda bx: bx >= rank)


def bx_hours(df, bx_values=None, require_full=True):
    """The hours behind each Bx with their rank.

    With ``require_full`` a day contributes to Bx only if it has x hours; without
    it, a short day lists what it has.
    """
    values = check_bx(bx_values)
    ranked = rank_hours(df, keep=values[-1]).select(
        "node", "opr_dt", "opr_hr", "mw", "hour_rank"
    )
    member_of = _bx_at_or_above(F.col("hour_rank"), values)
    if require_full:
        day = Window.partitionBy("node", "opr_dt")
        ranked = ranked.withColumn("_hours", F.max("hour_rank").over(day))
        member_of = F.filter(member_of, lambda bx: bx <= F.col("_hours"))
    return ranked.select(
        "node",
        "opr_dt",
        F.explode(member_of).alias("bx_type"),
        "hour_rank",
        "opr_hr",
        "mw",
    )


def daily_rank(df):
    """Price rank of every hour within its node-day."""
    return df.withColumn(
        "rank", F.row_number().over(_by_price(["node", "opr_dt"]))
    )


def cheapest_hours_ranked(df, date, bx):
    """Rank table of one date: the ``bx`` cheapest hours of every node."""
    day = df.where(F.col("opr_dt") == F.lit(date).cast("date"))
    return rank_hours(day, keep=check_bx([bx])[0]).select(
        "node",
        "opr_dt",
        "opr_hr",
        "mw",
        F.col("hour_rank").alias("rank_position"),
        F.lit(date).cast("date").alias("date_computed"),
    )


def _zone_daily(df, price):
    """Label zone results with their level in the daily Bx layout."""
    return df.select(
        F.when(F.col("zone") == OVERALL, "overall").otherwise("zone").alias("level"),
        F.col("zone").alias("node"),
        "opr_dt",
        "bx_type",
        as_price(price).alias("avg_price"),
    )


def bx_zone_pooled(df, mapping, bx_values=None):
    """Zone Bx over the pooled cheapest hours of the zone's nodes.

    Every node keeps its x cheapest hours (or fewer, if it has fewer) and all
    kept rows weigh the same. Ranks are summed per zone-day before they are
    spread over the Bx values, so the spread handles ten rows per zone-day.
    """
    values = check_bx(bx_values)
    per_rank = (
        attach_zone(rank_hours(df, keep=values[-1]), mapping)
        .groupBy("zone", "opr_dt", "hour_rank")
        .agg(F.sum("mw").alias("_sum"), F.count("mw").alias("_count"))
    )
    return _zone_daily(
        zone_and_overall(per_rank, ["opr_dt", "hour_rank"])
        .withColumn("bx_type", F.explode(_bx_at_or_above(F.col("hour_rank"), values)))
        .groupBy("zone", "opr_dt", "bx_type")
        .agg((F.sum("_sum").cast("double") / F.sum("_count")).alias("_avg")),
        "_avg",
    )


def _bx_of_hourly(hourly, values):
    """Bx per zone-day of hourly zone prices; short days average what they have.

    ``hourly`` is (zone, opr_dt, hour, price): at most 25 rows per zone-day.
    """
    ranked = rank_hours(
        hourly, ["zone", "opr_dt"], price="price", hour="hour", keep=values[-1]
    )
    return (
        ranked.withColumn(
            "bx_type", F.explode(_bx_at_or_above(F.col("hour_rank"), values))
        )
        .groupBy("zone", "opr_dt", "bx_type")
        .agg(F.avg("price").alias("_avg"))
    )


def hourly_zone_means(df, mapping):
    """Average price over the nodes of each zone, and of all nodes, per hour."""
    per_zone = (
        attach_zone(df, mapping)
        .groupBy("zone", "opr_dt", F.col("opr_hr").alias("hour"))
        .agg(F.sum("mw").alias("_sum"), F.count("mw").alias("_count"))
    )
    return zone_and_overall(per_zone, ["opr_dt", "hour"]).select(
        "zone",
        "opr_dt",
        "hour",
        (F.col("_sum").cast("double") / F.col("_count")).alias("price"),
    )


def bx_zone_of_means(df, mapping, bx_values=None):
    """Zone Bx of the hourly zone averages."""
    values = check_bx(bx_values)
    return _zone_daily(_bx_of_hourly(hourly_zone_means(df, mapping), values), "_avg")


def bx_zone_hourly(zone_hourly, bx_values=None):
    """Bx of published hourly zone prices; Overall averages the zones first."""
    values = check_bx(bx_values)
    hourly = (
        zone_hourly.withColumn("_zone", F.explode(F.array(F.col("zone"), F.lit(OVERALL))))
        .groupBy(F.col("_zone").alias("zone"), "opr_dt", F.col("hour_num").alias("hour"))
        .agg(F.avg("lmp").cast("double").alias("price"))
    )
    return _zone_daily(_bx_of_hourly(hourly, values), "_avg")


def common_bx_hours(df, bx):
    """For each node, the hours most often among its x cheapest, in hour order."""
    keep = check_bx([bx])[0]
    counts = (
        bx_hours(df, [keep])
        .where(F.col("opr_hr").isin(list(HOURS)))
        .groupBy("node", "opr_hr")
        .agg(F.count(F.lit(1)).alias("days"))
    )
    often = Window.partitionBy("node").orderBy(F.col("days").desc(), "opr_hr")
    hours = F.sort_array(F.collect_list("opr_hr"))
    return (
        counts.withColumn("_rank", F.row_number().over(often))
        .where(F.col("_rank") <= keep)
        .groupBy("node")
        .agg(hours.alias("hours"), F.array_join(hours, ", ").alias("hours_text"))
    )


def node_daily_summary(df, done_dates=None):
    """Price profile of every node-day with its B6 and B8.

    The median is the upper one for an even number of hours, and a short day
    averages the hours it has. ``done_dates`` (opr_dt) are left out. The price
    key is unique, so a node-day is at most 25 rows.
    """
    rows = df.where(F.col("mw").isNotNull())
    if done_dates is not None:
        rows = rows.join(done_dates.select("opr_dt"), "opr_dt", "left_anti")
    price = F.col("mw")
    ranked = rows.select(
        "node",
        "opr_dt",
        "mw",
        F.row_number().over(_by_price(["node", "opr_dt"])).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy("node", "opr_dt")).alias("_hours"),
    )
    middle = F.col("_rank") == F.floor(F.col("_hours") / 2) + 1
    return ranked.groupBy("node", "opr_dt").agg(
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        as_price(F.avg(price)).alias("avg_price"),
        F.max(F.when(middle, price)).alias("median_price"),
        F.count(F.lit(1)).alias("total_hours"),
        as_price(F.avg(F.when(F.col("_rank") <= 6, price))).alias("b6_avg_price"),
        as_price(F.avg(F.when(F.col("_rank") <= 8, price))).alias("b8_avg_price"),
    )


def missing_bx_dates(prices, daily):
    """Dates with prices but without any Bx."""
    return (
        prices.select("opr_dt")
        .distinct()
        .join(daily.select("opr_dt").distinct(), "opr_dt", "left_anti")
        .orderBy("opr_dt")
    )


def pending_bx(prices, daily, bx_values=None):
    """(date, bx) pairs still to be calculated."""
    values = check_bx(bx_values)
    return (
        prices.select("opr_dt")
        .distinct()
        .withColumn("bx_type", F.explode(F.array(*[F.lit(v) for v in values])))
        .join(
            daily.select("opr_dt", "bx_type").distinct(),
            ["opr_dt", "bx_type"],
            "left_anti",
        )
        .orderBy("opr_dt", "bx_type")
    )
