"""A stored table of nodes: a lasting number, first and last day, and name trigrams.

Prices are read once, when their days are loaded; look-ups afterwards read names only.
The table and its trigrams lie together in one numbered folder. An update writes the next
folder whole and then drops those before the last two, so a reader never sees a half and
a failed update leaves the old one.
"""

from pyspark.sql import Window, functions as F

from hourgrid.operators.nodes import all_nodes, search_nodes
from hourgrid.sources import paths

GRAM = 3
# Nodes are numbered in this many lanes, so that no task numbers them all.
LANES = 256
NODES = "node string, node_id long, first_day date, last_day date"


def _versions(spark, path):
    """Finished versions, oldest first."""
    return [v for v in paths.list_folders(spark, path) if paths.exists(spark, f"{path}/{v}/done")]


def read_nodes(spark, path):
    """node, node_id, first_day, last_day; empty before the first update."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], NODES)
    return spark.read.schema(NODES).parquet(f"{path}/{versions[-1]}/nodes")


def numbered(known, seen):
    """``known`` widened by ``seen`` (node, first_day, last_day); old numbers stay.

    A number is 1 + lane + LANES * place in the lane. Lanes come from a hash of the name,
    so numbers are close to gapless and every lane goes on by itself.
    """
    lane = F.pmod(F.xxhash64("node"), F.lit(LANES))
    both = (
        known.unionByName(seen.withColumn("node_id", F.lit(None).cast("long")))
        .groupBy("node")
        .agg(
            F.max("node_id").alias("node_id"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
        .withColumn("_lane", lane)
    )
    places = F.max(F.expr(f"(node_id - 1) div {LANES}")).over(Window.partitionBy("_lane"))
    order = Window.partitionBy("_lane", F.col("node_id").isNull()).orderBy("node")
    place = F.coalesce(places, F.lit(-1)) + F.row_number().over(order)
    return both.select(
        "node",
        F.coalesce("node_id", 1 + F.col("_lane") + LANES * place).alias("node_id"),
        "first_day",
        "last_day",
    )


def trigrams(nodes):
    """Every three characters of every lower-cased name, once per name."""
    low = F.lower("node")
    starts = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    grams = F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))
    return nodes.where(F.length(low) >= GRAM).select(
        F.explode(F.array_distinct(grams)).alias("gram"), "node"
    )


def update_nodes(spark, path, prices):
    """Take the nodes of some prices in; the same prices again change nothing."""
    seen = prices.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("opr_dt").alias("first_day"), F.max("opr_dt").alias("last_day")
    )
    versions = _versions(spark, path)
    number = int(versions[-1]) + 1 if versions else 1
    folder = f"{path}/{number:08d}"
    paths.drop_folder(spark, folder)
    numbered(read_nodes(spark, path), seen).write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema(NODES).parquet(f"{folder}/nodes")
    # In order of the grams, so that a look-up reads the row groups of its own only.
    trigrams(nodes).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(
        f"{folder}/grams"
    )
    spark.range(1).write.parquet(f"{folder}/done")
    for old in versions[:-1]:
        paths.drop_folder(spark, f"{path}/{old}")


def stored_nodes(spark, path, mapping=None, limit=None):
    """All nodes by name; those of the mapping as long as none is stored."""
    nodes = read_nodes(spark, path)
    if mapping is not None and nodes.isEmpty():
        nodes = mapping.select(F.col("pnode_id").alias("node")).where(F.col("node").isNotNull())
    return all_nodes(nodes, limit)


def find_nodes(spark, path, term, limit=None):
    """Nodes containing ``term``, any case, as ``search_nodes`` finds them in prices.

    The names that share all trigrams of the term are candidates and are checked. A term
    without a trigram, or with other than ASCII characters, goes over all stored names.
    """
    nodes = read_nodes(spark, path)
    low = term.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    versions = _versions(spark, path)
    if grams and term.isascii() and versions:
        index = spark.read.schema("gram string, node string")
        shared = (
            index.parquet(f"{path}/{versions[-1]}/grams")
            .where(F.col("gram").isin(grams))
            .groupBy("node")
            .agg(F.count(F.lit(1)).alias("_shared"))
        )
        nodes = shared.where(F.col("_shared") == len(grams)).select("node")
    return search_nodes(nodes, term, limit)
