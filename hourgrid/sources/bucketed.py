"""Prices and mapping as tables that share one distribution.

Both are bucketed by node into the same number of buckets, prices by month besides. What
goes by node or by node and day (ranks, Bx, zones of nodes) then needs no shuffle of
prices, however large the mapping is: a window and a join find the rows of a node in one
place already. Choose the number of buckets once, so that a bucket of a month is a file of
about 128 MB; both tables must have the same.
"""

from pyspark.sql import functions as F

from hourgrid.schemas import PRICE_SCHEMA
from hourgrid.sources import paths

PRICE_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PRICE_SCHEMA.fields)
OVERWRITE = "partitionOverwriteMode"


def open_prices(spark, table, path, buckets):
    """The table of the prices below ``path``, registered if this session lacks it.

    It carries the overwrite mode itself, so writes do not depend on the session's.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({PRICE_COLUMNS}, year int, month int) "
        f"USING parquet OPTIONS ({OVERWRITE} 'dynamic') "
        f"PARTITIONED BY (year, month) CLUSTERED BY (node) "
        f"SORTED BY (node, opr_dt, opr_hr) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    if paths.list_folders(spark, path):
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def open_mapping(spark, table, path, buckets):
    """The table of the mapping below ``path``."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (pnode_id string, zone string) USING parquet "
        f"CLUSTERED BY (pnode_id) SORTED BY (pnode_id) INTO {int(buckets)} BUCKETS "
        f"LOCATION '{path}'"
    )
    return spark.table(table)


def _buckets(spark, table):
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Num Buckets'")
    return int(rows.first().data_type)


def _replaces_months(spark, table):
    """Whether an overwrite leaves the months that it does not name."""
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Storage Properties'")
    own = rows.first()
    if own is not None and f"{OVERWRITE}=dynamic".lower() in own.data_type.lower():
        return True
    return spark.conf.get(f"spark.sql.sources.{OVERWRITE}").lower() == "dynamic"


def replace_months(df, table):
    """Replace the months present in ``df``, one file per bucket and month."""
    spark = df.sparkSession
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PRICE_SCHEMA.fields
    ]
    rows = df.select(*columns, F.year("opr_dt").alias("year"), F.month("opr_dt").alias("month"))
    if not _replaces_months(spark, table):
        raise ValueError(f"{table} or the session must have {OVERWRITE} dynamic")
    rows.repartition(_buckets(spark, table), "node").write.insertInto(table, overwrite=True)


def replace_mapping(mapping, table):
    """The whole mapping, one row per node."""
    spark = mapping.sparkSession
    rows = mapping.select("pnode_id", "zone").repartition(_buckets(spark, table), "pnode_id")
    rows.write.insertInto(table, overwrite=True)
