"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.
Each step keeps, for the next one, only rows whose value so far occurs again. It
tells them apart in place, by a broadcast set of bits whose size is fixed: two rows
that share a bit by chance only cost one hash more. So texts never move, and only
survivors are read in full.

Defined cases: null and empty texts form one group; of equal texts the row with the
largest doc_id stays, and rows that repeat that doc_id stay together; a null doc_id
is smaller than any other; other columns are kept as they are.
"""

from pyspark.sql import functions as F

from hourgrid.llm.common import UPPER
from hourgrid.session import cut_lineage

PREFIX = 256
# One bit per value of a step: 2 MB as words of 64 bits, whatever the input size.
BITS = 1 << 24


def digest(text):
    """SHA-256 of a text column with A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.unhex(F.sha2(lowered.cast("binary"), 256))


def _bit(key):
    return F.pmod(key, F.lit(BITS))


def repeated(keys):
    """Words of the bit set of all hashes in column ``key`` that occur more than once."""
    bits = keys.select(_bit("key").alias("bit")).groupBy("bit").count()
    word = F.expr("bit div 64").alias("word")
    mask = F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask")
    return bits.where("count > 1").groupBy(word).agg(mask)


def mark(df, words, key):
    """``df`` with a column ``again``: whether the hash ``key`` may occur again."""
    bit = _bit(key)
    hit = F.coalesce(F.getbit("mask", F.pmod(bit, F.lit(64)).cast("int")), F.lit(0)) == 1
    joined = df.withColumn("word", F.floor(bit / 64)).join(
        F.broadcast(words), "word", "left"
    )
    return joined.withColumn("again", hit).drop("word", "mask")


def refine(docs):
    """``docs`` with ``again``: true for every text that may have an equal one.

    Lower-casing A-Z keeps the number of bytes. The prefix is lower-cased in full,
    which can only make more texts survive, never fewer.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    by_size = F.xxhash64(size)
    by_prefix = F.xxhash64(size, F.lower(F.substring(F.coalesce("text", F.lit("")), 1, PREFIX)))
    sizes = repeated(docs.select(by_size.alias("key")))
    first = mark(docs, sizes, by_size)
    prefixes = repeated(first.where("again").select(by_prefix.alias("key")))
    first = first.withColumnRenamed("again", "same_size")
    second = mark(first, prefixes, F.when(F.col("same_size"), by_prefix))
    return second.drop("same_size")


def exact_groups(scratch, docs, all_digests=False):
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    The digest is null where refinement proved the text unique, unless
    ``all_digests`` asks for it.
    """
    marked = refine(docs.select("doc_id", "text"))
    full = digest(F.col("text"))
    narrow = scratch.stage(
        marked.select(
            "doc_id",
            "again",
            full.alias("digest")
            if all_digests
            else F.when(F.col("again"), full).alias("digest"),
        ),
        "digests",
    )
    rows = narrow.where("again")
    # Staged, so that the join shuffles both sides anew and can split a large group.
    groups = scratch.stage(
        rows.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    grouped = rows.join(groups, "digest")
    alone = narrow.where(~F.col("again")).select(
        "digest", "doc_id", "again", F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    return grouped.unionByName(alone).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_duplicates(docs):
    """The documents that stay. Texts that refinement proves unique are not moved."""
    columns = docs.columns
    marked = refine(docs)
    rows = marked.where("again").withColumn("digest", digest(F.col("text")))
    # A table of its own, so that the join can split a large group.
    keep = cut_lineage(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "keep")
    same = (F.col("r.digest") == F.col("k.digest")) & F.col("r.doc_id").eqNullSafe(
        F.col("k.keep_id")
    )
    kept = rows.alias("r").join(keep.alias("k"), same, "left_semi")
    return kept.select(*columns).unionByName(marked.where(~F.col("again")).select(*columns))
