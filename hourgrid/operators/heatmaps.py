"""Hour and month x hour averages, and their matrix forms."""

from pyspark.sql import functions as F

from hourgrid.functions.filters import keep_nodes
from hourgrid.functions.periods import in_year
from hourgrid.operators.zones import attach_zone, zone_and_overall
from hourgrid.schemas import HOURS, MONTHS, OVERALL


def _mean():
    return (F.col("_sum").cast("double") / F.col("_count")).alias("avg_price")


def _sums(rows, *keys):
    return rows.groupBy(*keys).agg(F.sum("mw").alias("_sum"), F.count("mw").alias("_count"))


def hourly_by_zone(prices, mapping, year=None):
    """Average price per hour for every zone and Overall."""
    rows = attach_zone(in_year(prices, year), mapping)
    hourly = _sums(rows, "zone", F.col("opr_hr").alias("hour"))
    return (
        zone_and_overall(hourly, ["hour"])
        .select("zone", "hour", _mean())
        .orderBy("zone", "hour")
    )


def month_hour_heatmap(prices, mapping, year=None):
    """Average and record count per zone, year, month and hour, plus Overall."""
    rows = attach_zone(in_year(prices, year), mapping)
    cells = _sums(
        rows,
        "zone",
        F.year("opr_dt").alias("year"),
        F.month("opr_dt").alias("month"),
        F.col("opr_hr").alias("hour"),
    )
    return zone_and_overall(cells, ["year", "month", "hour"]).select(
        "zone", "year", "month", "hour", _mean(), F.col("_count").alias("record_count")
    )


PARTIAL_KEY = ("node", "year", "month", "hour")


def month_hour_partials(prices):
    """Sum and count of prices per node, year, month and hour, which add up."""
    cells = _sums(
        prices,
        "node",
        F.year("opr_dt").alias("year"),
        F.month("opr_dt").alias("month"),
        F.col("opr_hr").alias("hour"),
    )
    return cells.select(
        *PARTIAL_KEY,
        F.col("_sum").cast("decimal(38,4)").alias("price_sum"),
        F.col("_count").alias("price_count"),
    )


def merged_partials(added, removed):
    """``added`` partials without the ``removed`` ones; cells without prices go."""
    minus = removed.withColumns(
        {name: -F.col(name) for name in ("price_sum", "price_count")}
    )
    return (
        added.unionByName(minus)
        .groupBy(*PARTIAL_KEY)
        .agg(
            F.sum("price_sum").cast("decimal(38,4)").alias("price_sum"),
            F.sum("price_count").alias("price_count"),
        )
        .where("price_count <> 0")
    )


def heatmap_of_partials(partials, mapping, year=None):
    """``month_hour_heatmap`` from stored partials; the mapping joins cells, not prices."""
    rows = partials if year is None else partials.where(F.col("year") == year)
    cells = (
        attach_zone(rows, mapping)
        .groupBy("zone", "year", "month", "hour")
        .agg(F.sum("price_sum").alias("_sum"), F.sum("price_count").alias("_count"))
    )
    return zone_and_overall(cells, ["year", "month", "hour"]).select(
        "zone", "year", "month", "hour", _mean(), F.col("_count").alias("record_count")
    )


def read_heatmap(heatmap, zone=None, year=None):
    """One zone of a stored heat-map (Overall by default)."""
    rows = heatmap.where(F.col("zone") == (zone or OVERALL))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return rows.select("month", "hour", "avg_price").orderBy("month", "hour")


def _clock_hours(prices, nodes, year):
    rows = keep_nodes(in_year(prices, year), nodes)
    return rows.where(F.col("opr_hr").isin(list(HOURS)))


def hourly_for_nodes(prices, nodes, year=None):
    """Pooled average per hour over the chosen nodes."""
    cells = _sums(_clock_hours(prices, nodes, year), F.col("opr_hr").alias("hour"))
    return cells.select("hour", _mean()).orderBy("hour")


def hourly_per_node(prices, nodes, year=None):
    """Average per hour of each chosen node."""
    cells = _sums(
        _clock_hours(prices, nodes, year), "node", F.col("opr_hr").alias("hour")
    )
    return cells.select("node", "hour", _mean()).orderBy("node", "hour")


def node_month_hour(prices, nodes, year=None):
    """Pooled average per month and hour over the chosen nodes."""
    cells = _sums(
        _clock_hours(prices, nodes, year),
        F.month("opr_dt").alias("month"),
        F.col("opr_hr").alias("hour"),
    )
    return cells.select("month", "hour", _mean()).orderBy("month", "hour")


def _hour_columns(df, *keys):
    return df.select(*keys, *[F.col(str(h)).alias(f"h{h}") for h in HOURS])


def pivot_node_hour(prices):
    """Node x hour matrix of mean prices."""
    wide = prices.groupBy("node").pivot("opr_hr", list(HOURS)).agg(F.avg("mw"))
    return _hour_columns(wide, "node").orderBy("node")


def pivot_month_hour(cells):
    """Month x hour matrix of (month, hour, avg_price); all twelve months present."""
    wide = cells.groupBy("month").pivot("hour", list(HOURS)).agg(F.avg("avg_price"))
    months = cells.sparkSession.range(MONTHS[0], MONTHS[-1] + 1).select(
        F.col("id").cast("int").alias("month")
    )
    return _hour_columns(months.join(wide, "month", "left"), "month").orderBy("month")


def price_histogram(df, column="mw", bins=30):
    """Equal-width bins from the lowest to the highest price; the top edge is closed."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = df.where(value.isNotNull()).select(value.alias("v"), ends.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    slot = F.when(F.col("e.hi") == F.col("e.lo"), 0).otherwise(
        F.least(
            F.floor(
                (F.col("v") - F.col("e.lo"))
                / F.nullif(F.col("e.hi") - F.col("e.lo"), F.lit(0.0))
                * bins
            ),
            F.lit(bins - 1),
        )
    )
    counted = placed.select(slot.cast("int").alias("bin")).groupBy("bin").count()
    edges = (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), ends.alias("e"))
        .where("e.lo is not null")
    )
    # Bins without a price stay, with zero records.
    return (
        edges.join(counted, "bin", "left")
        .select(
            "bin",
            (F.col("e.lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("e.lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("count", F.lit(0)).cast("long").alias("records"),
        )
        .orderBy("bin")
    )
