"""Price tables and mappings derived from the star-schema test tables.

``dense``  one month, nearly every hour; prices with zeros and negatives, components
``long``   seven years at five nodes, for weeks, months, years and heat-maps
``wide``   as many nodes as there are suppliers, so it grows with the data
"""

from pyspark.sql import functions as F

from hourgrid.operators.zones import node_zone_map
from hourgrid.schemas import PRICE

# The zone that stands for each region; other regions have none.
ZONE_OF_REGION = {"AFRICA": "NP15", "AMERICA": "SP15", "ASIA": "ZP26"}


class Tables:
    """The tables of one folder and what is derived from them."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder

    def table(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def zones(self):
        label = F.lit("Not found")
        for region, zone in ZONE_OF_REGION.items():
            label = F.when(F.col("r_name") == region, zone).otherwise(label)
        return self.table("region").select(
            F.col("r_regionkey").alias("resource_id"), label.alias("zone")
        )

    def dense_map(self):
        nodes = self.table("nation").select(
            F.col("n_name").alias("pnode_id"), F.col("n_regionkey").alias("resource_id")
        )
        return node_zone_map(nodes, self.zones())

    def long_map(self):
        nodes = self.table("region").select(
            F.col("r_name").alias("pnode_id"), F.col("r_regionkey").alias("resource_id")
        )
        return node_zone_map(nodes, self.zones())

    def wide_nodes(self):
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_name").alias("pnode_id"),
                F.col("n_regionkey").alias("resource_id"),
            )
        )

    def wide_map(self):
        return node_zone_map(self.wide_nodes(), self.zones())

    def dense(self):
        value = F.col("value")
        events = self.table("events").select(
            (F.col("user_id") % 25).cast("int").alias("n_nationkey"),
            F.to_date("ts").alias("opr_dt"),
            (F.hour("ts") + 1).alias("opr_hr"),
            F.when(value < 5, 0).otherwise(value - 10).cast(PRICE).alias("mw"),
            (value - 40).cast(PRICE).alias("mcc"),
            (value - 5).cast(PRICE).alias("mlc"),
            F.when(value > 60, value).cast(PRICE).alias("pos"),
        )
        return (
            events.join(self.table("nation"), "n_nationkey")
            .groupBy(F.col("n_name").alias("node"), "opr_dt", "opr_hr")
            .agg(*[F.min(c).alias(c) for c in ("mw", "mcc", "mlc", "pos")])
        )

    def _items(self):
        return self.table("lineitem").select(
            "l_suppkey",
            F.trunc("l_shipdate", "MM").alias("first_day"),
            "l_linenumber",
            (F.col("l_orderkey") % 24 + 1).cast("int").alias("opr_hr"),
            (F.col("l_extendedprice") / 100).cast(PRICE).alias("mw"),
        )

    def long(self):
        regions = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("node"))
        )
        return (
            self._items()
            .join(regions, "l_suppkey")
            .groupBy(
                "node",
                F.date_add("first_day", F.col("l_linenumber") - 1).alias("opr_dt"),
                "opr_hr",
            )
            .agg(F.min("mw").alias("mw"))
        )

    def wide(self):
        suppliers = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("node")
        )
        return (
            self._items()
            .join(suppliers, "l_suppkey")
            .groupBy("node", F.col("first_day").alias("opr_dt"), "opr_hr")
            .agg(F.min("mw").alias("mw"))
        )

    def zone_hourly(self):
        """Published hourly zone prices, from the long table's mapped nodes."""
        zones = self.long_map().where(F.col("zone").isNotNull())
        return (
            self.long()
            .join(zones, F.col("node") == F.col("pnode_id"))
            .select(
                "opr_dt",
                F.col("opr_hr").alias("hour_num"),
                "zone",
                F.col("mw").cast("decimal(10,5)").alias("lmp"),
            )
        )

    def raw_text(self):
        """Unclean text rows under generic file headers, with repeated keys."""
        kind, value = F.col("event_type"), F.col("value")
        number = (
            F.when(kind == "error", F.lit("abc"))
            .when(kind == "view", (value * 100).cast("string"))
            .when(kind == "signup", (value - 1100).cast("string"))
            .otherwise(value.cast("string"))
        )
        return self.table("events").select(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("IntervalStartTime_GMT"),
            F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("Node_Id"),
            F.concat(F.lit("N"), (F.col("user_id") % 25).cast("string")).alias("Node"),
            number.alias("MW_Price"),
            (value - 40).cast("string").alias("Congestion"),
            F.col("event_id").alias("row_id"),
        )
