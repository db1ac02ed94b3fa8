"""Node-to-zone mapping: build, look up, enrich.

No broadcast hint is given: the mapping grows with the nodes, so Spark decides
from its measured size and falls back to a (skew-split) shuffle join.
"""

from pyspark.sql import Window, functions as F

from hourgrid.schemas import NO_ZONE, OVERALL, UNMAPPED


def node_zone_map(nodes, zones):
    """Resolve pricing node -> resource -> zone, one row per node.

    ``nodes`` has (pnode_id, resource_id), ``zones`` (resource_id, zone, ...).
    A node with several resources keeps one that has a zone, if any does.
    """
    labelled = zones.withColumn(
        "zone", F.when(~F.col("zone").isin(*NO_ZONE), F.col("zone"))
    )
    best = Window.partitionBy("pnode_id").orderBy(
        F.col("zone").isNull(),
        F.col("resource_id").asc_nulls_last(),
        F.col("zone").asc_nulls_last(),
    )
    return (
        nodes.select("pnode_id", "resource_id")
        .distinct()
        .join(labelled, "resource_id", "left")
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= 1)
        .select(
            "pnode_id", *[c for c in labelled.columns if c != "pnode_id"]
        )
    )


def attach_zone(df, mapping):
    """Left-join the zone; nodes without one get NULL."""
    lookup = mapping.select(F.col("pnode_id").alias("node"), "zone")
    return df.drop("zone").join(lookup, "node", "left")


def enrich_zone(df, mapping):
    """Zone of every row, with a label for unmapped nodes."""
    return attach_zone(df, mapping).withColumn(
        "zone", F.coalesce("zone", F.lit(UNMAPPED))
    )


def zone_filtered(df, mapping, zone):
    """Rows of the nodes mapped to ``zone``."""
    members = mapping.where(F.col("zone") == zone).select(
        F.col("pnode_id").alias("node"), "zone"
    )
    return df.drop("zone").join(members, "node")


def zone_and_overall(partials, keys, total="_sum", count="_count"):
    """Roll (zone, keys) sums up to zones plus one Overall group.

    Runs on rows already summed per zone, so the second grouping adds a few rows
    instead of doubling the input as a grouping set would. Unmapped rows (zone
    NULL) count in Overall only.
    """
    labels = F.array_compact(F.array(F.col("zone"), F.lit(OVERALL)))
    return (
        partials.withColumn("_zone", F.explode(labels))
        .groupBy(F.col("_zone").alias("zone"), *keys)
        .agg(F.sum(total).alias(total), F.sum(count).alias(count))
    )


def zone_for_node(mapping, node):
    return mapping.where(F.col("pnode_id") == node).select("pnode_id", "zone")


def nodes_for_zone(mapping, zone):
    return mapping.where(F.col("zone") == zone).select("pnode_id").orderBy("pnode_id")


def available_zones(mapping):
    return (
        mapping.where(F.col("zone").isNotNull()).select("zone").distinct().orderBy("zone")
    )


def mapping_stats(mapping):
    return mapping.agg(
        F.count(F.lit(1)).alias("total_mappings"),
        F.countDistinct("zone").alias("unique_zones"),
        F.count(F.when(F.col("zone").isNull(), 1)).alias("unmapped_nodes"),
        F.count("zone").alias("mapped_nodes"),
    )


def nodes_per_zone(mapping):
    return (
        mapping.where(F.col("zone").isNotNull())
        .groupBy("zone")
        .agg(F.count(F.lit(1)).alias("node_count"))
        .orderBy("zone")
    )
