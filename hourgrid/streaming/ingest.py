"""Price files as they arrive, with the results of the batch load.

The stream's checkpoint remembers which files were read, ``maxFilesPerTrigger`` is the
batch size, and an ``availableNow`` run ends when nothing is waiting. A micro-batch that
is replayed after a failure leaves what one run of it leaves: stored keys stay, Bx rows
are written by key, the report by batch, and the ledger tells the attempts of a batch
from those of others.
"""

from pyspark.sql import functions as F

from hourgrid.operators.cleaning import dedupe_keep_first
from hourgrid.plans import jobs, ledger
from hourgrid.plans.jobs import PRICE_KEY, store_bx
from hourgrid.schemas import ARCHIVE_GLOB
from hourgrid.session import Scratch
from hourgrid.sources import archives, store

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def archive_files(spark, landing, max_files=20):
    """Archives as they arrive: path, length, modificationTime and content."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", ARCHIVE_GLOB)
        .option("maxFilesPerTrigger", max_files)
        .load(landing)
    )


def archive_stream(spark, landing, max_files=20):
    """Price rows of archives as they arrive; unreadable archives have none."""
    return archives.ingest_zip(archive_files(spark, landing, max_files))


def stream_archives(
    files, store_path, checkpoint, name, daily_path=None, mapping=None, report_path=None
):
    """Load a stream of archives as ``load_batch`` does, until it is drained.

    Every micro-batch loads its archives, their Bx and, below ``report_path`` in a
    folder of its own, one report row per archive, bad ones too. ``name`` tells the
    stream from others in the ledger; archives that another load has finished, in the
    same version, are skipped.
    """

    def load(batch, number):
        spark = batch.sparkSession
        run = f"{name}-{number}"
        with Scratch(spark, "stream") as scratch:
            held = batch.select(
                "path",
                "length",
                F.col("modificationTime").alias("modified"),
                jobs.file_name(F.col("path")).alias("file"),
            ).where(archives.archive_date(F.col("path")).isNotNull())
            seen = scratch.stage(ledger.states(held, ledger.read(spark, store_path), run), "seen")
            wanted = seen.where(~F.col("loaded"))
            content = batch.select("path", "content").join(wanted.select("path"), "path", "left_semi")
            report = jobs.load_files(
                spark,
                wanted.select("file", "length", "modified", "republished"),
                content,
                store_path,
                daily_path,
                mapping,
                run,
            )
            if report_path is not None:
                skipped = jobs.report_rows(seen.where("loaded"), "skipped")
                report.unionByName(skipped).write.mode("overwrite").parquet(
                    f"{report_path}/batch={number}"
                )

    return _drained(files, load, checkpoint)


def parquet_stream(spark, landing, schema, max_files=20):
    """Price rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)


def stream_daily_ingest(prices, store_path, checkpoint, daily_path=None, mapping=None, order=None):
    """Add a stream of price rows to the day store (and its Bx) until it is drained.

    As in the batch load a stored key stays, and of the rows of one key in a
    micro-batch the first by ``order`` does: file and row where the rows have them,
    all columns otherwise.
    """
    if order is None:
        order = [c for c in ("source_file", "row_id") if c in prices.columns]
        order = order or [c for c in sorted(prices.columns) if c not in PRICE_KEY]

    def add(batch, _):
        spark = batch.sparkSession
        with Scratch(spark, "stream") as scratch:
            rows = scratch.stage(dedupe_keep_first(batch, PRICE_KEY, order), "rows")
            store.append_prices(rows, store_path)
            if daily_path is not None:
                days = store.on_days(store.read_prices(spark, store_path), rows)
                store_bx(spark, days, mapping, daily_path)

    return _drained(prices, add, checkpoint)


def _drained(rows, write, checkpoint):
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
