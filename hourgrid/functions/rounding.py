"""Rounding that gives the same digits on every engine."""

from pyspark.sql import functions as F, types as T

from hourgrid.schemas import PRICE


def as_column(value):
    return F.col(value) if isinstance(value, str) else value


def round_to(value, digits):
    """Round half away from zero after fixing four spare digits.

    Going through a decimal hides the last-bit noise of floating sums, so a tie
    falls the same way whatever order the rows were added in.
    """
    exact = as_column(value).cast(T.DecimalType(20, digits + 4))
    return F.round(exact, digits).cast("double")


def as_price(value):
    """Stored form of an averaged price: four decimals, half up."""
    return F.round(as_column(value).cast(T.DecimalType(20, 8)), 4).cast(PRICE)


def round_all(df, digits=4):
    """Round every fractional column of a result."""
    columns = [
        round_to(f.name, digits).alias(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)
