"""Price spikes against a rolling window."""

from pyspark.sql import Window, functions as F

from hourgrid.functions.filters import filter_prices
from hourgrid.functions.rounding import round_to
from hourgrid.schemas import ROLLING_ROWS

# Five months have 153 days at most, or 3,826 hours; a window keeps 4,096 rows in memory.
PART_MONTHS = 5


def _with_history(rows, lookback):
    """Cut each node's series into parts of some months and hand each its history.

    A window over (node, part) then sees the same ``lookback`` preceding rows as
    one over the whole series, while no task holds more than a part of a node,
    and a part fits the buffer of rows that a window keeps in memory.
    Only the last rows of a part can be history, so only those are copied. A row goes
    to every part within ``lookback`` rows, so short parts of a sparse series cost copies.
    """
    month = F.year("opr_dt") * 12 + F.month("opr_dt")
    series = rows.withColumn("_part", F.floor(month / PART_MONTHS))
    newest = Window.partitionBy("node", "_part").orderBy(
        F.col("opr_dt").desc(), F.col("opr_hr").desc()
    )
    tails = (
        series.withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= lookback)
        .drop("_back")
    )
    ahead = (
        Window.partitionBy("node").orderBy("opr_dt", "opr_hr").rowsBetween(1, lookback)
    )
    history = (
        tails.withColumn("_parts", F.collect_set("_part").over(ahead))
        .withColumn("_target", F.explode("_parts"))
        .where(F.col("_target") != F.col("_part"))
        .drop("_parts", "_part")
        .withColumnRenamed("_target", "_part")
    )
    return series.withColumn("_own", F.lit(True)).unionByName(
        history.withColumn("_own", F.lit(False))
    )


def price_spikes(
    df, threshold_std=3, start=None, end=None, exclude_zero=True, rows=ROLLING_ROWS
):
    """Prices above the rolling mean by more than ``threshold_std`` deviations.

    The frame counts the rows left after the filter and includes the row itself;
    a row without a positive deviation is never a spike.
    """
    prices = filter_prices(df, start, end, exclude_zero=exclude_zero).select(
        "node", "opr_dt", "opr_hr", "mw"
    )
    return _latest_first(_spikes(_with_history(prices, rows - 1), threshold_std, rows))


def _latest_first(spikes):
    # The sort samples its input first; over the few rebalanced spikes that costs
    # nothing, over the windows it would compute them twice.
    return spikes.hint("rebalance").orderBy(
        F.col("operational_date").desc(), F.col("operational_hour").desc(), "node"
    )


def _spikes(parts, threshold_std, rows):
    """Spikes among the own rows of every (node, _part)."""
    frame = (
        Window.partitionBy("node", "_part")
        .orderBy("opr_dt", "opr_hr")
        .rowsBetween(1 - rows, 0)
    )
    price = F.col("mw").cast("double")
    return (
        parts.withColumn("_mean", F.avg(price).over(frame))
        .withColumn("_std", F.stddev_samp(price).over(frame))
        .where(F.col("_own") & (F.col("_std") > 0))
        .where(price > F.col("_mean") + F.lit(float(threshold_std)) * F.col("_std"))
        .select(
            F.col("opr_dt").alias("operational_date"),
            F.col("opr_hr").alias("operational_hour"),
            "node",
            round_to("mw", 2).alias("mw"),
            round_to("_mean", 2).alias("rolling_mean"),
        )
    )


def last_rows(prices, rows=ROLLING_ROWS):
    """The rows of each node that frames of later rows reach back to."""
    newest = Window.partitionBy("node").orderBy(F.col("opr_dt").desc(), F.col("opr_hr").desc())
    return (
        prices.select("node", "opr_dt", "opr_hr", "mw")
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") < rows)
        .drop("_back")
    )


def spikes_after(tails, df, threshold_std=3, exclude_zero=True, rows=ROLLING_ROWS):
    """Spikes of new days alone, and the tails that the days after them need.

    ``tails`` are the :func:`last_rows` before the first new day, under the same filter.
    The spikes are those that :func:`price_spikes` finds on these days in all prices.
    """
    new = filter_prices(df, exclude_zero=exclude_zero).select("node", "opr_dt", "opr_hr", "mw")
    both = tails.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    parts = _with_history(both, rows - 1).withColumn("_own", F.col("_own") & F.col("_new"))
    return _spikes(parts, threshold_std, rows), last_rows(both, rows)
