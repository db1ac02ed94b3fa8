"""Schemas and fixed values shared by every module."""

from pyspark.sql import types as T

PRICE = T.DecimalType(12, 4)
COMPONENT = T.DecimalType(10, 5)

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("node", T.StringType(), False),
        T.StructField("mw", PRICE, False),
        T.StructField("opr_dt", T.DateType(), False),
        T.StructField("opr_hr", T.IntegerType(), False),
        T.StructField("source_file", T.StringType()),
        T.StructField("mcc", PRICE),
        T.StructField("mlc", PRICE),
        T.StructField("pos", PRICE),
    ]
)

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("pnode_id", T.StringType(), False),
        T.StructField("resource_id", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("local_area", T.StringType()),
        T.StructField("generator_name", T.StringType()),
    ]
)

ZONE_HOURLY_SCHEMA = T.StructType(
    [
        T.StructField("opr_dt", T.DateType(), False),
        T.StructField("hour_num", T.IntegerType(), False),
        T.StructField("zone", T.StringType(), False),
        T.StructField("lmp", COMPONENT, False),
        T.StructField("congestion", COMPONENT),
        T.StructField("energy", COMPONENT),
        T.StructField("loss", COMPONENT),
    ]
)

BX_DAILY_SCHEMA = T.StructType(
    [
        T.StructField("level", T.StringType(), False),
        T.StructField("node", T.StringType(), False),
        T.StructField("opr_dt", T.DateType(), False),
        T.StructField("bx_type", T.IntegerType(), False),
        T.StructField("avg_price", PRICE),
        T.StructField("min_hour", T.IntegerType()),
        T.StructField("max_hour", T.IntegerType()),
    ]
)

# Fixed values.
BX_VALUES = (4, 5, 6, 7, 8, 9, 10)
HOURS = tuple(range(1, 25))
MONTHS = tuple(range(1, 13))
PEAK_HOURS = (0, 6)
PRICE_CEILING = 10000
PRICE_FLOOR = -1000
ROLLING_ROWS = 24
UNMAPPED = "UNMAPPED"
OVERALL = "Overall"
MARKET = "MARKET_SUMMARY"
ARCHIVE_GLOB = "*DAM_LMP*.zip"
ARCHIVE_DATE = r"(\d{4})(\d{2})(\d{2})_\d{8}_DAM_LMP"
PRICE_MEMBER = "PRC_LMP_DAM_LMP"
NO_ZONE = ("Not found", "")
ZONE_HEADERS = {
    "NP15": ("NP-15 LMP", "NP-15 (Congestion)", "NP-15 (Energy)", "NP-15 (Loss)"),
    "SP15": ("SP-15 LMP", "SP-15 (Congestion)", "SP-15 (Energy)", "SP-15 (Loss)"),
    "ZP26": ("ZP-26 LMP", "ZP-26 (Congestion)", "ZP-26 (Energy)", "ZP-26 (Loss)"),
}
