"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``docs``. Only documents that a stage's operator
decides against go: toxic ones, all but one of equal texts, all but one of each group
of near duplicates, and those that hold a benchmark item.
"""

from pyspark.sql import functions as F

from hourgrid.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from hourgrid.llm.common import nested
from hourgrid.llm.settings import END_ID, SEQUENCE, STAGE_SHINGLE_WORDS, TOKENIZER, TOXIC
from hourgrid.session import Scratch, cut_lineage

# Learned models, sketches and alignments have no counterpart in SQL.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents whose calibrated score stays below the limit."""
    with Scratch(spark, "toxicity") as scratch:
        model = toxicity.learn(scratch, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(nested(docs)).where(F.col("toxicity") < TOXIC).select("row.*")


def drop_copies(spark, docs, sf_dir):
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(nested(docs)).select("row.*")


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of near duplicates, the one with the smallest doc_id, null first.

    Rows go by doc_id and text, so others with the same doc_id, or also none, stay.
    """
    with Scratch(spark, "near") as scratch:
        rows = near_dedup.near_rows(scratch, docs, STAGE_SHINGLE_WORDS)
        gone = rows.where(~F.col("kept")).select(
            F.col("doc_id").alias("gone"), F.col("digest").alias("gone_digest")
        )
        gone = cut_lineage(gone, "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone")) & (near_dedup.digest() == F.col("gone_digest"))
    return nested(docs).join(gone, same, "left_anti").select("row.*")


def drop_leaks(spark, docs, sf_dir):
    """Documents without any benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_leaks(nested(docs), benchmark)
    return found.where(F.size("leaks") == 0).select("row.*")


def pack(spark, docs, sf_dir):
    """The pieces of every remaining document, by sequence."""
    with Scratch(spark, "packing") as scratch:
        pieces = packing.pack(scratch, docs, TOKENIZER, END_ID, SEQUENCE)
        return cut_lineage(packing.digests(pieces), "packing")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark, sf_dir):
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
