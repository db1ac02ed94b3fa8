"""Shards of near equal bytes by sampled splitters.

Rows are ordered by (hash of text, doc_id), so copies are neighbours. Splitters are
quantiles of a size-weighted sample of that key; they cut the table into many more
ranges than shards. Ranges that the exact totals show to be overfull are subdivided
by a sample of their own. Every row then gets its exact place in the whole order from
the totals of the ranges before it and a running sum within its range, and the shard
is the place in bytes divided evenly. No window spans more than one range.

Defined cases: a null text counts as empty with hash of null; repeated rows keep
neighbouring places; an empty table gives no row; other columns are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 64
ROWS_PER_RANGE = 64  # at least, so that a small table is not cut into single rows
RECORD_BYTES = 16
ROUNDS = 4
ORDER = ("key", "doc_id", "size", "text_crc32")


def records(docs):
    """The narrow row of each document: sizes, checksum and key, no text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
    )


def place():
    return F.struct("key", F.coalesce("doc_id", F.lit(1 - (1 << 63))).alias("doc_id"))


def sampled(rows, target, wanted):
    """Keys drawn with a chance in proportion to size: about ``wanted`` per target bytes.

    The draw is a hash of the row, so a repeated task draws the same keys.
    """
    chance = F.col("size") * F.lit(wanted / max(target, 1))
    draw = F.pmod(F.xxhash64("doc_id", "key", "size"), F.lit(1 << 30)) / F.lit(1 << 30)
    return rows.where(draw < chance)


def quantiles(sample, group, parts):
    """Boundaries that cut each group's sample into ``parts``, at most parts - 1 of them."""
    by_place = Window.partitionBy(*group).orderBy("place")
    tile = F.ntile(parts).over(by_place).alias("tile")
    tiles = sample.withColumn("place", place()).select(*group, "place", tile)
    firsts = tiles.groupBy(*group, "tile").agg(F.min("place").alias("place"))
    return [row.place for row in firsts.where("tile > 1").select("place").distinct().collect()]


def with_range(rows, splitters):
    """``rows`` with ``range``, the number of splitters at or before their place.

    The splitters are a sorted literal of two levels, so a row is compared with
    about twice the square root of their number.
    """
    splitters = sorted((s.key, s.doc_id) for s in splitters)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    if not blocks:
        return rows.withColumn("range", F.lit(0))

    def literal(pairs):
        items = (f"named_struct('key', {k}L, 'doc_id', {d}L)" for k, d in pairs)
        return f"array({', '.join(items)})"

    def at_or_before(array):
        return F.size(F.filter(array, lambda s: s <= F.col("place")))

    outer = F.expr(literal([block[0] for block in blocks]))
    inner = F.expr(f"array({', '.join(map(literal, blocks))})")
    return (
        rows.withColumn("place", place())
        .withColumn("block", at_or_before(outer))
        .withColumn(
            "range",
            F.when(F.col("block") == 0, 0).otherwise(
                (F.col("block") - 1) * step
                + at_or_before(F.element_at(inner, F.greatest("block", F.lit(1))))
            ),
        )
        .drop("place", "block")
    )


def shard_by_bytes(scratch, docs, shards):
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    rows = scratch.stage(records(docs), "records")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(shards * RANGES_PER_SHARD, count // ROWS_PER_RANGE))
    target = -(-total // ranges)
    splitters = quantiles(sampled(rows, target, SAMPLES_PER_RANGE), [], ranges)
    totals = None
    for _ in range(ROUNDS):
        ranged = with_range(rows, splitters)
        totals = (
            ranged.groupBy("range")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
            .orderBy("range")
            .collect()
        )
        overfull = [t.range for t in totals if t.bytes > 2 * target and t.n > 1]
        if not overfull:
            break
        inside = ranged.where(F.col("range").isin(overfull))
        more = quantiles(sampled(inside, target, SAMPLES_PER_RANGE), ["range"], 4)
        if not set(more) - set(splitters):
            break
        splitters = list(set(splitters) | set(more))
    ranged = with_range(rows, splitters)
    starts, n_before, bytes_before = [], 0, 0
    for t in totals or []:
        starts.append((t.range, n_before, bytes_before))
        n_before, bytes_before = n_before + t.n, bytes_before + t.bytes
    starts = docs.sparkSession.createDataFrame(
        starts, "range int, rows_before long, bytes_before long"
    )
    # A few thousand ranges at most: the number of shards bounds them.
    within = Window.partitionBy("range").orderBy(*ORDER)
    placed = (
        ranged.withColumn("row", F.row_number().over(within))
        .withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(starts), "range")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("row") - 1).alias("at"),
            (F.col("bytes_before") + F.col("end") - F.col("size")).alias("start"),
        )
        .withColumn(
            "shard",
            F.expr(f"cast(cast(start as decimal(28,0)) * {shards} div {max(total, 1)} as int)"),
        )
    )
    placed = scratch.stage(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")
    )
