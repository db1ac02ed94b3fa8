"""Bottom-k and top-k reports.

Prices are shown with two decimals and sorted by what is shown; the full key
breaks ties, so the same rows come back on every run.
"""

from pyspark.sql import functions as F

from hourgrid.functions.filters import filter_prices, require_columns
from hourgrid.functions.quantiles import quantile_scalar
from hourgrid.functions.rounding import round_to


def cheapest_hours(df, n_hours=10, node=None, start=None, end=None, exclude_zero=True):
    return (
        filter_prices(df, start, end, node, exclude_zero)
        .select(
            F.col("opr_dt").alias("operational_date"),
            F.col("opr_hr").alias("operational_hour"),
            "node",
            round_to("mw", 2).alias("mw"),
        )
        .orderBy("mw", "operational_date", "operational_hour", "node")
        .limit(n_hours)
    )


def cheapest_hours_raw(df, n_hours=10, node=None, start=None, end=None):
    """Unrounded twin over all prices, with the price components."""
    return (
        filter_prices(
            require_columns(df, "mcc", "mlc"), start, end, node, exclude_zero=False
        )
        .select(
            F.col("opr_dt").alias("operational_date"),
            F.col("opr_hr").alias("operational_hour"),
            "node",
            "mw",
            "mcc",
            "mlc",
        )
        .orderBy("mw", "operational_date", "operational_hour", "node")
        .limit(n_hours)
    )


def cheapest_hours_aggregated(
    df, nodes, n_hours=10, start=None, end=None, exclude_zero=True
):
    """Cheapest hours of the average over several nodes."""
    return (
        filter_prices(df, start, end, nodes, exclude_zero)
        .groupBy(
            F.col("opr_dt").alias("operational_date"),
            F.col("opr_hr").alias("operational_hour"),
        )
        .agg(round_to(F.avg("mw"), 2).alias("mw"))
        .select(
            "operational_date",
            "operational_hour",
            F.lit(f"Aggregated_{len(nodes)}_nodes").alias("node"),
            "mw",
        )
        .orderBy("mw", "operational_date", "operational_hour")
        .limit(n_hours)
    )


def cheapest_nodes_by_hour(
    df, n_nodes=10, operational_date=None, operational_hour=None, exclude_zero=True
):
    rows = filter_prices(df, operational_date, operational_date, None, exclude_zero)
    if operational_hour is not None:
        rows = rows.where(F.col("opr_hr") == operational_hour)
    return (
        rows.select(
            F.col("opr_dt").alias("operational_date"),
            "node",
            round_to("mw", 2).alias("mw"),
            "opr_hr",
        )
        .orderBy("mw", "operational_date", "opr_hr", "node")
        .limit(n_nodes)
    )


def lowest_congestion_hours(
    df, n_hours=10, during_cheap_hours=False, start=None, end=None, exclude_zero=True
):
    """Hours with the lowest congestion, optionally among the cheapest fifth."""
    rows = filter_prices(
        require_columns(df, "mcc").where(F.col("mcc").isNotNull()),
        start,
        end,
        exclude_zero=exclude_zero,
    )
    if during_cheap_hours:
        threshold = quantile_scalar(rows, "mw", 0.2)
        rows = rows.where(F.col("mw").cast("double") <= threshold)
    return (
        rows.select(
            F.col("opr_dt").alias("operational_date"),
            F.col("opr_hr").alias("operational_hour"),
            "node",
            round_to("mw", 2).alias("mw"),
            round_to("mcc", 2).alias("mcc"),
        )
        .orderBy("mcc", "operational_date", "operational_hour", "node")
        .limit(n_hours)
    )


def top_nodes(stats, metric="mean", n_nodes=10, ascending=True):
    """Cheapest or dearest nodes of a statistics table."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return stats.orderBy(order, "node").limit(n_nodes)
