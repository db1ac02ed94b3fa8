"""Validation and de-duplication."""

from pyspark.sql import Window, functions as F

PRICE_KEY = ("opr_dt", "opr_hr", "node")


def dedupe_keep_first(df, keys, order):
    """One row per key, the first by ``order``.

    The rank filter is applied per input partition before the shuffle, so a key
    with very many copies sends one row per partition.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= 1)
        .drop("_rank")
    )


def clean_and_validate(df, order, keys=PRICE_KEY, price="mw"):
    """Drop incomplete rows and keep the first of each key."""
    return dedupe_keep_first(df.dropna(subset=[*keys, price]), keys, order)


def upsert_keep_latest(existing, new, keys):
    """Merge ``new`` into ``existing``: a key in both takes the new row."""
    merged = existing.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return dedupe_keep_first(merged, keys, [F.col("_new").desc()]).drop("_new")


def insert_ignore(existing, new, keys):
    """The rows of ``new`` whose key is not in ``existing``."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def delete_range(df, start=None, end=None):
    """Rows outside an inclusive date range; an unbounded delete is refused."""
    doomed = F.lit(True)
    if start is None and end is None:
        raise ValueError("give a start or an end date")
    if start is not None:
        doomed = doomed & (F.col("opr_dt") >= F.lit(start).cast("date"))
    if end is not None:
        doomed = doomed & (F.col("opr_dt") <= F.lit(end).cast("date"))
    return df.where(~doomed)
