"""Node and calendar lookups."""

from pyspark.sql import functions as F

from hourgrid.functions.periods import in_month, in_year


def all_nodes(df, limit=None):
    nodes = df.select("node").distinct().orderBy("node")
    return nodes if limit is None else nodes.limit(limit)


def search_nodes(df, term, limit=None):
    """Distinct nodes containing ``term``, any case; wildcards match themselves."""
    literal = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return all_nodes(df.where(F.col("node").ilike(f"%{literal}%")), limit)


def nodes_by_prefix(df, prefix, min_length=2):
    """Distinct nodes starting with ``prefix``, any case."""
    if len(prefix) < min_length:
        raise ValueError(f"prefix needs at least {min_length} characters")
    return all_nodes(df.where(F.upper("node").startswith(prefix.upper())))


def selected_nodes(current, matching):
    """Union of two node selections without repeats."""
    return current.select("node").union(matching.select("node")).distinct()


def available_dates(df, year=None, month=None):
    if year is not None:
        df = in_year(df, year) if month is None else in_month(df, year, month)
    return df.select("opr_dt").distinct().orderBy("opr_dt")


def available_years(df, first=None, last=None):
    years = df.select(F.year("opr_dt").alias("year")).distinct()
    if first is not None:
        years = years.where(F.col("year") >= first)
    if last is not None:
        years = years.where(F.col("year") <= last)
    return years.orderBy(F.col("year").desc())


def available_months(monthly, year):
    return (
        monthly.where(F.col("year_month").startswith(f"{year}-"))
        .select("year_month")
        .distinct()
        .orderBy("year_month")
    )
