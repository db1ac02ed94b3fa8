"""Daily ZIP archives of price files.

Unzipping is the one step Spark has no expression for, so it runs as a
``mapInPandas`` over the binary files, one archive at a time and in bounded
chunks. A task reads at most ``spark.sql.files.maxPartitionBytes`` of archives,
or one larger archive. Typing, cleaning and everything later stay in the JVM.
"""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from hourgrid.schemas import ARCHIVE_DATE, ARCHIVE_GLOB, PRICE_MEMBER
from hourgrid.sources.columns import STRICT_COLUMNS, resolve_price_columns, typed_prices

CHUNK_ROWS = 200_000
TEXT_COLUMNS = ("node", "mw", "opr_dt", "opr_hr", "mcc", "mlc", "pos")
UNPACKED = (
    "source_file string, row_no long, "
    + ", ".join(f"{name} string" for name in TEXT_COLUMNS)
    + ", error string"
)


def list_archives(spark, path):
    """Archive files below ``path`` without their content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", ARCHIVE_GLOB)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("file"), "length", "modificationTime")
    )


def read_archives(spark, path):
    """Archive files below ``path`` as (path, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", ARCHIVE_GLOB)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )


def archive_date(file):
    """Operating date in an archive name, NULL if there is none."""
    parts = [F.regexp_extract(file, ARCHIVE_DATE, i) for i in (1, 2, 3)]
    return F.concat_ws("-", *parts).try_cast("date")


def unprocessed_files(files, done_dates, batch_size=None):
    """Archives whose date is not loaded yet, first ``batch_size`` by name."""
    waiting = (
        files.withColumn("opr_dt", archive_date(F.col("file")))
        .join(done_dates.select("opr_dt").distinct(), "opr_dt", "left_anti")
        .select("file", "opr_dt")
        .orderBy("file")
    )
    return waiting if batch_size is None else waiting.limit(batch_size)


def _text_chunks(content):
    """Text frames of the first price member of one archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        member = next(
            (n for n in archive.namelist() if PRICE_MEMBER in n and n.endswith(".csv")),
            None,
        )
        if member is None:
            raise ValueError("no price member in archive")
        with archive.open(member) as stream:
            header = list(pd.read_csv(stream, nrows=0, dtype=str).columns)
        found = resolve_price_columns(header)
        if any(name not in found for name in STRICT_COLUMNS):
            raise ValueError("required columns missing")
        with archive.open(member) as stream:
            yield from (
                chunk.set_axis(
                    [name for name, _ in sorted(found.items(), key=lambda p: p[1])],
                    axis=1,
                )
                for chunk in pd.read_csv(
                    stream,
                    dtype=str,
                    keep_default_na=False,
                    na_values=[],
                    usecols=sorted(found.values()),
                    chunksize=CHUNK_ROWS,
                    on_bad_lines="skip",
                    index_col=False,
                )
            )


def _unpack(batches):
    names = ["source_file", "row_no", *TEXT_COLUMNS, "error"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            file = path.rsplit("/", 1)[-1]
            rows = 0
            try:
                for chunk in _text_chunks(content):
                    missing = dict.fromkeys(set(names) - set(chunk.columns))
                    numbers = range(rows, rows + len(chunk))
                    rows += len(chunk)
                    yield chunk.assign(**{**missing, "row_no": numbers, "source_file": file})[names]
            except Exception as problem:  # a bad archive is reported, not fatal
                report = dict.fromkeys(names)
                report.update(source_file=file, row_no=rows, error=str(problem) or "bad archive")
                yield pd.DataFrame([report], columns=names).astype({"row_no": "int64"})


def unpack_archives(archives):
    """Text rows of every archive, plus one error row per unreadable one."""
    return archives.select("path", "content").mapInPandas(_unpack, UNPACKED)


def ingest_zip(archives):
    """Price rows of the archives, typed and without unusable rows."""
    rows = unpack_archives(archives).where(F.col("error").isNull())
    return typed_prices(rows.withColumnRenamed("row_no", "row_id"))


def archive_status(unpacked):
    """Rows, usable rows and error of every archive in an unpacked batch."""
    usable = typed_prices(unpacked).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("records")
    )
    return (
        unpacked.groupBy("source_file")
        .agg(F.max("error").alias("error"))
        .join(usable, "source_file", "left")
        .select(
            "source_file",
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce(
                "error", F.when(F.col("records").isNull(), F.lit("no valid records"))
            ).alias("error"),
        )
    )
