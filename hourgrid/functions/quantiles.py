"""Exact statistics and interpolated quantiles that never gather a group in one task.

The built-in exact ``percentile`` keeps a value map of the whole group in one
task, which a market-wide or hot group does not survive. Here the prices are
first summed up per whole currency unit. Running counts over those few rows say
which unit holds each wanted rank, and only the units so named are resolved value
by value in a second pass. A stored price has four decimals, so one unit holds at
most 10,000 distinct values, and equal values are combined before they are
shuffled. The moments come from the per-unit rows, so they cost no further scan.
"""

from pyspark.sql import Window, functions as F

from hourgrid.session import cut_lineage


def _position(fraction):
    return F.lit(float(fraction)) * (F.col("_n") - 1)


def _ranks(fraction):
    """Zero-based ranks on both sides of a fraction."""
    return F.floor(_position(fraction)), F.ceil(_position(fraction))


def _holds(rank, first):
    return (rank >= F.col(first)) & (rank < F.col(first) + F.col("_c"))


def _per_unit(rows, unit, counts):
    """Count, extremes and offsets from the unit's lower edge, per unit."""
    offset = F.col("_v").cast("double") - F.col("_unit")
    return rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_c"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.sum(offset).alias("_d1"),
        F.sum(offset * offset).alias("_d2"),
        *[F.count(F.when(rule(F.col("_v")), 1)).alias(n) for n, rule in counts.items()],
    )


def _placed(per_unit, by, counts):
    """Every unit with the rank it starts at and the moments of its group."""
    group = Window.partitionBy(*by)
    upto = group.orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_unit") * F.col("_c") + F.col("_d1")
    # Two unordered windows: the second needs the mean of the first.
    sums = per_unit.select(
        *by,
        "_unit",
        "_c",
        "_d1",
        "_d2",
        F.sum("_c").over(upto).alias("_upto"),
        F.sum("_c").over(group).alias("_n"),
        F.sum(total).over(group).alias("_total"),
        F.min("_lo").over(group).alias("min"),
        F.max("_hi").over(group).alias("max"),
        *[F.sum(name).over(group).alias(name) for name in counts],
    )
    edge = F.col("_unit") - F.col("_total") / F.col("_n")
    squares = F.col("_d2") + 2 * edge * F.col("_d1") + F.col("_c") * edge * edge
    return sums.select(
        *by,
        "_unit",
        "_c",
        "_n",
        "min",
        "max",
        *counts,
        (F.col("_upto") - F.col("_c")).alias("_before"),
        (F.col("_total") / F.col("_n")).alias("avg"),
        F.sum(squares).over(group).alias("_m2"),
    ).withColumn(
        "std", F.sqrt(F.greatest("_m2", F.lit(0.0)) / F.nullif(F.col("_n") - 1, F.lit(0)))
    )


def _resolve(rows, targets, unit):
    """Distinct values of the target units with their counts.

    The staged targets have a known size, by which Spark chooses the join: few are
    broadcast, so that the rows of other units go no further.
    """
    carried = [F.max(c).alias(c) for c in targets.columns if c not in unit]
    return (
        rows.join(targets, unit)
        .groupBy(*unit, "_v")
        .agg(F.count(F.lit(1)).alias("_c"), *carried)
    )


def price_profile(df, by, value, quantiles, counts=None):
    """Count, avg, std, min, max and quantiles of ``value`` per ``by``.

    ``quantiles`` maps output names to fractions, interpolated linearly;
    ``counts`` maps names to conditions on the value to be counted. The first
    pass runs when the function is called, since its result decides how the
    second one joins.
    """
    by, counts = list(by), dict(counts or {})
    unit = [*by, "_unit"]
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).alias("_v"), F.floor(value).cast("long").alias("_unit")
    )
    placed = _placed(_per_unit(rows, unit, counts), by, counts)
    facts = ["avg", "std", "min", "max", *counts]
    wanted = F.lit(False)
    for fraction in quantiles.values():
        for rank in _ranks(fraction):
            wanted = wanted | _holds(rank, "_before")
    targets = cut_lineage(placed.where(wanted).select(*unit, "_before", "_n", *facts))

    within = (
        Window.partitionBy(*unit).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = _resolve(rows, targets, unit).withColumn(
        "_first", F.col("_before") + F.sum("_c").over(within) - F.col("_c")
    )
    picks = []
    for name, fraction in quantiles.items():
        for side, rank in zip(("lo", "hi"), _ranks(fraction)):
            hit = F.when(_holds(rank, "_first"), F.col("_v").cast("double"))
            picks.append(F.max(hit).alias(f"_{side}_{name}"))
    carried = [F.max(name).alias(name) for name in facts]
    ends = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *carried, *picks)

    def interpolate(name, fraction):
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = _position(fraction) - F.floor(_position(fraction))
        return (low + (high - low) * share).alias(name)

    return ends.select(
        *by,
        F.coalesce("_n", F.lit(0)).alias("count"),
        *facts,
        *[interpolate(name, fraction) for name, fraction in quantiles.items()],
    )


def exact_quantiles(df, by, value, quantiles):
    """The quantiles of :func:`price_profile` alone."""
    return price_profile(df, by, value, quantiles).select(*by, *quantiles)


def quantile_scalar(df, value, fraction):
    """One quantile of a whole column, as a scalar subquery column."""
    return exact_quantiles(df, [], value, {"q": fraction}).scalar()
