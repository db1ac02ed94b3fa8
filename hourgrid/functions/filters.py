"""Row filters shared by the analytical operators."""

from pyspark.sql import DataFrame, functions as F

from hourgrid.functions.periods import date_window


def keep_nodes(df, nodes, column="node"):
    """Keep one node, a list of nodes, or the nodes of a frame.

    A frame (first column) is matched with a semi join, so a long selection
    never turns into a long literal list.
    """
    if nodes is None:
        return df
    if isinstance(nodes, DataFrame):
        wanted = nodes.select(F.col(nodes.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi")
    if isinstance(nodes, str):
        return df.where(F.col(column) == nodes)
    names = list(nodes)
    if len(names) == 1:
        return df.where(F.col(column) == names[0])
    return df.where(F.col(column).isin(names))


def filter_prices(df, start=None, end=None, nodes=None, exclude_zero=True):
    """The common filter: positive prices, inclusive dates, chosen nodes."""
    if exclude_zero:
        df = df.where(F.col("mw") > 0)
    return keep_nodes(date_window(df, start, end), nodes)


def require_columns(df, *names):
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df
