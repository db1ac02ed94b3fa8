"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

from hourgrid.sources.paths import drop_folder

# AQE sizes the shuffles at run time: start with many small partitions and let
# it merge them towards the advisory size, split skewed ones, and switch a join
# to broadcast only after the real size of the side is known.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app="hourgrid", master=None, shuffle_partitions=None, **extra):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder all executors see, as the cluster names it.

    Only a local-mode session without the setting falls back to a temporary
    folder; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hourgrid-"))
    return context.getCheckpointDir()


def scratch_path(spark, label):
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/hourgrid/{label}-{uuid.uuid4().hex}"


def write_and_read(df, path, compression="snappy"):
    """Write ``df`` once and read it back.

    Later uses start from the files, also after executors were lost, and the
    planner knows their real size.
    """
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, label="staged"):
    """``df`` as a table in the shared folder that outlives the caller."""
    return write_and_read(df, scratch_path(df.sparkSession, label))


class Scratch:
    """A folder below the shared one that lasts as long as the job using it.

    Tables staged in it must not be read after the ``with`` block.
    """

    def __init__(self, spark, label):
        self.spark = spark
        self.path = scratch_path(spark, label)
        self.count = 0

    def __enter__(self):
        return self

    def __exit__(self, *error):
        drop_folder(self.spark, self.path)

    def folder(self, label):
        """A path of its own inside the scratch folder."""
        self.count += 1
        return f"{self.path}/{self.count:03d}-{label}"

    def stage(self, df, label="staged", compression="snappy"):
        return write_and_read(df, self.folder(label), compression)
