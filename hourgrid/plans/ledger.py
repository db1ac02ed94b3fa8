"""What became of every archive, kept beside the day store.

The ledger is a log: a row per archive and attempt, with the length and modification
time the archive had, so a republished one is told from the one that was loaded. Rows
are only appended; states are derived. Forgetting an archive is a row as well.
"""

from pyspark.sql import functions as F

from hourgrid.sources import paths

SCHEMA = (
    "file string, length long, modified timestamp, run string, at timestamp, "
    "status string, error string"
)
PROCESSED, ERROR, FORGOTTEN = "processed", "error", "forgotten"


def folder(store_path):
    return f"{store_path}/_loaded"


def read(spark, store_path):
    """The attempts that count: those after an archive was last forgotten.

    Rows of older ledgers have a name only; they stand for any version of it.
    """
    if not paths.exists(spark, folder(store_path)):
        return spark.createDataFrame([], SCHEMA)
    log = spark.read.schema(SCHEMA).parquet(folder(store_path))
    log = log.withColumn("status", F.coalesce("status", F.lit(PROCESSED)))
    forgotten = log.where(F.col("status") == FORGOTTEN).groupBy("file").agg(
        F.max("at").alias("until")
    )
    counts = F.col("until").isNull() | (F.col("at") > F.col("until"))
    attempts = log.where(F.col("status") != FORGOTTEN)
    return attempts.join(forgotten, "file", "left").where(counts).drop("until")


def note(rows, store_path, run):
    """Append attempts: file, length, modified, status, error."""
    rows = rows.withColumn("run", F.lit(run)).withColumn("at", F.current_timestamp())
    columns = [name.split(" ")[0] for name in SCHEMA.split(", ")]
    rows.select(*columns).write.mode("append").parquet(folder(store_path))


def forget(files, store_path, run):
    """Let the archives in ``files`` (column ``file``) be loaded again."""
    nothing = F.lit(None)
    rows = files.select(
        "file",
        nothing.cast("long").alias("length"),
        nothing.cast("timestamp").alias("modified"),
        F.lit(FORGOTTEN).alias("status"),
        nothing.cast("string").alias("error"),
    )
    note(rows, store_path, run)


def states(files, log, run=None):
    """``files`` (file, length, modified, ...) with what the ledger says of each.

    ``loaded``: this version was loaded, in another run than ``run``; ``republished``:
    another version was; ``attempts``: how often this version failed; ``tried``: the
    version had an attempt in ``run``.
    """
    mine = F.coalesce(F.col("run") == F.lit(run), F.lit(False))
    done = (F.col("status") == PROCESSED) & ~mine
    versions = (
        log.groupBy("file", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
        .agg(
            F.max(done).alias("_done"),
            F.count_if(F.col("status") == ERROR).alias("_errors"),
            F.max(mine).alias("_tried"),
        )
    )
    same = F.col("_length").isNull() | (
        (F.col("_length") == F.col("length")) & (F.col("_modified") == F.col("modified"))
    )
    no = F.lit(False)
    return (
        files.join(versions, "file", "left")
        .groupBy(*files.columns)
        .agg(
            F.coalesce(F.max(F.col("_done") & same), no).alias("loaded"),
            F.coalesce(F.max(F.col("_done") & ~same), no).alias("republished"),
            F.coalesce(F.sum(F.when(same, F.col("_errors"))), F.lit(0)).alias("attempts"),
            F.coalesce(F.max(F.col("_tried") & same), no).alias("tried"),
        )
    )


def failed_archives(spark, store_path):
    """Archives whose last attempts failed: file, attempts and the last error."""
    log = read(spark, store_path)
    return (
        log.groupBy("file", "length", "modified")
        .agg(
            F.count_if(F.col("status") == ERROR).alias("attempts"),
            F.max_by("error", "at").alias("error"),
            F.max_by("status", "at").alias("status"),
            F.max("at").alias("at"),
        )
        .groupBy("file")
        .agg(F.max_by(F.struct("attempts", "error", "status"), "at").alias("last"))
        .select("file", "last.*")
        .where(F.col("status") == ERROR)
        .drop("status")
    )
