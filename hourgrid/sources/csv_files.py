"""CSV readers: price files, mapping files, zone files."""

import csv
import functools
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.cleaning import clean_and_validate, dedupe_keep_first
from hourgrid.schemas import COMPONENT, ZONE_HEADERS
from hourgrid.sources import paths as file_system
from hourgrid.sources.columns import (
    STRICT_COLUMNS,
    clean_numeric,
    derive_date_hour,
    resolve_price_columns,
    standardize_columns,
    typed_prices,
    typed_standard,
    validate_format,
)


def read_text_csv(spark, path):
    """Header CSV with every column as text, plus the file and row position."""
    rows = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )
    return rows.select(
        *[F.col(f"`{name}`").alias(name.lstrip("﻿")) for name in rows.columns],
        F.col("_metadata.file_name").alias("source_file"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("row_id"),
    )


def parse_price_csv(raw):
    """Strict layout: operating date and hour, node and price by header name."""
    found = resolve_price_columns(raw.columns)
    missing = [name for name in STRICT_COLUMNS if name not in found]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    kept = [name for name in ("source_file", "row_id") if name in raw.columns]
    return typed_prices(
        raw.select(
            *[F.col(f"`{raw.columns[i]}`").alias(name) for name, i in found.items()],
            *kept,
        )
    )


def standardize_csv(raw):
    """Generic layout: rename header variants, derive dates, coerce prices."""
    if not validate_format(raw.columns):
        raise ValueError("not a price file: header patterns missing")
    return typed_standard(clean_numeric(derive_date_hour(standardize_columns(raw))))


# Canonical price column to table column.
TABLE_COLUMNS = {
    "INTERVALSTARTTIME_GMT": "interval_start_time_gmt",
    "NODE": "node",
    "MW": "mw",
    "MCC": "mcc",
    "MLC": "mlc",
    "POS": "pos",
    "DAY_OF_WEEK": "day_of_week",
    "opr_dt": "opr_dt",
    "opr_hr": "opr_hr",
    "source_file": "source_file",
    "row_id": "row_id",
}


def to_price_table(standard, order=("row_id",)):
    """Standardised rows as clean price rows: complete, unique, sorted."""
    rows = standard.select(
        *[F.col(old).alias(new) for old, new in TABLE_COLUMNS.items() if old in standard.columns]
    )
    return clean_and_validate(rows, list(order))


def load_price_csv(spark, path):
    """Read, parse and de-duplicate strict price files."""
    parsed = parse_price_csv(read_text_csv(spark, path))
    return dedupe_keep_first(parsed, ["node", "opr_dt", "opr_hr"], ["row_id"]).drop("row_id")


def read_mapping(spark, zone_path, node_path):
    """The two mapping files as (nodes, zones) frames for ``node_zone_map``."""
    zones = read_text_csv(spark, zone_path).select(
        F.col("`Resource ID`").alias("resource_id"),
        F.col("`Matched Zone`").alias("zone"),
        F.col("`Local Area`").alias("local_area"),
        F.col("`Generator Name`").alias("generator_name"),
    )
    nodes = read_text_csv(spark, node_path).select(
        F.col("PNODE_ID").alias("pnode_id"), F.col("RES_ID").alias("resource_id")
    )
    return nodes, zones


def _zone_day(text):
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
    ).cast("date")


def zone_wide_to_long(wide, kept=()):
    """One row per date, hour and zone from the wide zone layout, with ``kept`` columns.

    ``wide`` has 'Local Date', 'Hour Number' and four columns per zone; a missing
    component column gives NULL.
    """

    def value(header):
        if header not in wide.columns:
            return F.lit(None).cast(COMPONENT)
        return F.col(f"`{header}`").cast("string").try_cast(COMPONENT)

    zones = [
        F.struct(
            F.lit(zone).alias("zone"),
            *[
                value(header).alias(name)
                for name, header in zip(("lmp", "congestion", "energy", "loss"), headers)
            ],
        )
        for zone, headers in ZONE_HEADERS.items()
    ]
    return (
        wide.select(
            *kept,
            _zone_day(F.col("`Local Date`").cast("string")).alias("opr_dt"),
            F.col("`Hour Number`").cast("string").try_cast("int").alias("hour_num"),
            F.explode(F.array(*zones)).alias("z"),
        )
        .select("opr_dt", "hour_num", "z.*", *kept)
        .dropna(subset=["opr_dt", "hour_num", "lmp"])
    )


ROW_ORDER = ("file_no", "block", "line")


def _zone_layouts(spark, files):
    """Files by header: {titles: {path: position in ``files``}}.

    A header is the first line with the two key titles. Only header lines reach the
    driver, one per file.
    """
    place = {}
    for number, file in enumerate(files):
        place.setdefault(file, number)
    lines = spark.read.text(list(place)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    headers = lines.where(
        F.col("value").contains("Local Date") & F.col("value").contains("Hour Number")
    )
    first = headers.groupBy("path").agg(F.min(F.struct("block", "line", "value")).alias("first"))
    layouts = {}
    for path, header in first.select("path", "first.value").orderBy("path").collect():
        titles = tuple(t.strip() for t in next(csv.reader([header.lstrip("\ufeff")])))
        number = max((n for f, n in place.items() if _same_file(path, f)), default=0)
        layouts.setdefault(titles, {})[path] = number
    return layouts


def _same_file(path, given):
    """Whether a listed file is the one that was given, or lies below it."""
    plain = unquote(path.split(":", 1)[-1]).lstrip("/")
    wanted = given.split(":", 1)[-1] if "://" in given else given
    wanted = wanted.strip("/")
    return plain == wanted or plain.startswith(f"{wanted}/") or plain.endswith(f"/{wanted}")


def read_zone_files(spark, files):
    """Zone prices of files with a preamble above the header, whatever their layout.

    Files that are not there are left out; None if none is. Files of one layout are
    read together by Spark's CSV reader, so no line is joined to its header; what is
    not a row of a date and an hour, such as the preamble, has no price and goes.
    The rows tell their ``file_no`` in ``files``, block and line.
    """
    present = [f for f in files if file_system.exists(spark, f)]
    layouts = _zone_layouts(spark, present) if present else {}
    parts = []
    for titles, numbers in layouts.items():
        names = [f"c{i}" for i in range(len(titles))]
        schema = ", ".join(f"{name} string" for name in names)
        reader = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True)
        rows = reader.csv(list(numbers))
        number = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
        path = F.col("_metadata.file_path")
        wide = rows.select(
            *[F.col(name).alias(title) for title, name in dict(zip(titles, names)).items()],
            number[path].alias("file_no"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        parts.append(zone_wide_to_long(wide, ROW_ORDER))
    if not parts:
        return None
    return functools.reduce(DataFrame.unionByName, parts)


def read_zone_csv(spark, paths):
    """Zone files of any layout as rows of day, hour, zone and prices."""
    found = read_zone_files(spark, [paths] if isinstance(paths, str) else list(paths))
    if found is None:
        raise ValueError("no zone file with a header")
    return found.drop(*ROW_ORDER)
