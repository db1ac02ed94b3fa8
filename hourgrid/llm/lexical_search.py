"""Exact ranked lexical search by buckets of vector lengths.

A document is a vector of integer impacts over terms, an item a vector of integer
weights; the score is their inner product. Only terms of the items matter, so one pass
over the texts keeps the frequencies of those and the number of all terms.

1. Documents are ordered by the length of their impact vector, longest first, and cut
   into buckets. The first bucket gives every item a first threshold: the score of its
   k-th best document there.
2. An item passes over a bucket if the length of its weights times the greatest length
   in the bucket stays below its threshold (Cauchy-Schwarz), and a task ends with the
   first bucket that all items pass over, as later ones are shorter.
3. Inside a bucket the heaviest coordinates of the item are taken until the rest alone
   could not reach the threshold. Only documents with one of these coordinates are
   looked at; their exact part on them plus the product of both remaining lengths is an
   upper bound, and those below the threshold go.
4. Survivors are scored again in 64-bit integers. The best k of a task, ties by
   doc_id, raise the threshold of its later buckets, and the best k of all tasks stay.

Bounds are in doubles and only remove documents that stay below a threshold by more
than rounding could explain, so the result is exact. The items go in blocks of bounded
text size, whose terms and weights tasks receive as a whole; documents are read once a
block, and only their item terms are staged and shuffled.

Defined cases: null, empty and term-free texts match nothing, as documents or as items;
a null doc_id comes before others of the same score; repeated documents rank one by one;
repeated items with one id and one text rank once, those with one id and several texts
once for each text; without documents or items the result is empty; other columns are
ignored.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from hourgrid.llm.common import arrow_schema

BLOCK_BYTES = 1 << 20  # of item texts in one pass over the documents
BUCKET = 4096  # documents
SLICE_ROWS = 256  # texts that a task holds as terms at a time
FEW = 48  # survivors that are scored one by one
INTS = ArrayType(IntegerType())
MARGIN = 1e-9  # relative error that bounds in doubles allow for

# impact = SCALE * tf div (1000 * tf + 12 * m).
SCALE, TF, NORM = 1_000_000_000, 1000, 12

# Every byte of a term as itself, A-Z as a-z, every other byte as a blank. Bytes of
# characters beyond ASCII belong to terms.
TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
).lower()


def terms_of(data):
    """The terms of UTF-8 bytes (None: none), with repeats."""
    return data.translate(TERM_BYTES).split() if data else []


def weight(documents, df):
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """A block of items over one numbered vocabulary."""

    def __init__(self, rows):
        counted = []
        for key, data in rows:
            found, repeats = np.unique(np.array(terms_of(data), object), return_counts=True)
            if len(found):
                counted.append((key, found, repeats))
        self.keys = [key for key, _, _ in counted]
        words = sorted({word for _, found, _ in counted for word in found})
        self.number = {word: i for i, word in enumerate(words)}
        self.terms = [np.array([self.number[w] for w in f], np.int64) for _, f, _ in counted]
        self.repeats = [repeats.astype(np.int64) for _, _, repeats in counted]


def frequencies(docs, number):
    """doc_id, n (all terms), and ids and tfs of the terms in ``number``."""
    schema = StructType([docs.schema["doc_id"], StructField("n", LongType())])
    schema = schema.add("ids", INTS).add("tfs", INTS)
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        get = number.get
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                n, ids, tfs, ends = [], [], [], [0]
                for data in part.column(1).to_pylist():
                    words = terms_of(data)
                    n.append(len(words))
                    counts = {}
                    for i in map(get, words):
                        if i is not None:
                            counts[i] = counts.get(i, 0) + 1
                    ids += counts
                    tfs += counts.values()
                    ends.append(len(ids))
                ends = pa.array(ends, pa.int32())
                columns = [
                    part.column(0),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
                ]
                yield record_batch(columns, target)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)


def record_batch(columns, target):
    return pa.RecordBatch.from_arrays(
        [column.cast(field.type) for column, field in zip(columns, target)], schema=target
    )


def lists(column):
    """The values of a list column and the row of each."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def document_frequencies(vectors, size):
    """Documents that hold each term, as an array on the driver (one number a term)."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            ids, _ = lists(batch.column(0))
            counts += np.bincount(ids, minlength=size)
        held = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(counts[held])], names=["id", "df"]
        )

    rows = vectors.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df"))
    df = np.zeros(size, np.int64)
    for term, count in rows.collect():
        df[term] = count
    return df


def impacts(vectors, documents, terms):
    """doc_id, ids, impact of each and the length of the impact vector, if not 0."""
    schema = StructType([vectors.schema["doc_id"], vectors.schema["ids"]])
    schema = schema.add("impacts", INTS).add("length", "double")
    target = arrow_schema(vectors.sparkSession, schema)
    size = 100 - 25 + F.expr(f"(25 * n * {documents}L) div {terms}L")

    def run(batches):
        for batch in batches:
            ids, tfs = batch.column(1), batch.column(2)
            tf, row = lists(tfs)
            tf = tf.astype(np.int64)
            m = batch.column(3).to_numpy()
            impact = SCALE * tf // (TF * tf + NORM * m[row])
            length = np.sqrt(np.bincount(row, impact.astype(float) ** 2, batch.num_rows))
            yield record_batch(
                [batch.column(0), ids, list_like(tfs, impact), pa.array(length)], target
            )

    held = vectors.where(F.size("ids") > 0).select("doc_id", "ids", "tfs", size.alias("m"))
    return held.mapInArrow(run, schema).where("length > 0")


def list_like(column, values):
    """``values`` cut as the lists of ``column``."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


class Bucket:
    """Documents of one bucket, their entries in the order of the terms."""

    def __init__(self, batch):
        self.doc_ids = batch.column(0)
        self.length = batch.column(3).to_numpy()
        self.rows = batch.num_rows
        ids, row = lists(batch.column(1))
        values, _ = lists(batch.column(2))
        self.row_ids, self.row_values = ids, values.astype(np.int64)
        self.row_start = np.searchsorted(row, np.arange(self.rows + 1))
        order = np.argsort(ids, kind="stable")
        self.ids, self.row, self.values = ids[order], row[order], self.row_values[order]
        # Place of each document by doc_id, null first.
        self.by_id = np.empty(self.rows, np.int64)
        sort = pc.array_sort_indices(self.doc_ids, null_placement="at_start")
        self.by_id[sort.to_numpy()] = np.arange(self.rows)

    def columns(self, terms):
        """Rows and impacts of the documents with each term."""
        start = np.searchsorted(self.ids, terms)
        end = np.searchsorted(self.ids, terms, side="right")
        return [(self.row[a:b], self.values[a:b]) for a, b in zip(start, end)]

    def survivors(self, query, threshold):
        """Rows whose bound reaches the threshold."""
        rest = query.rest * self.length.max() * (1 + MARGIN)
        focus = int(np.argmax(rest < threshold))  # the rest of length 0 is always below
        partial, squares = np.zeros(self.rows), np.zeros(self.rows)
        for (rows, values), w in zip(self.columns(query.terms[:focus]), query.weights):
            values = values.astype(float)
            partial[rows] += w * values
            squares[rows] += values * values
        left = np.sqrt(np.maximum(self.length**2 * (1 + MARGIN) - squares, 0))
        bound = (partial + query.rest[focus] * left) * (1 + MARGIN)
        return np.nonzero((partial > 0) & (bound >= threshold))[0]

    def scores(self, query, rows):
        """Exact scores of rows."""
        if len(rows) <= FEW:
            dense = query.dense
            spans = [(self.row_start[r], self.row_start[r + 1]) for r in rows]
            return np.array(
                [dense[self.row_ids[a:b]] @ self.row_values[a:b] for a, b in spans], np.int64
            )
        score = np.zeros(self.rows, np.int64)
        for (held, values), w in zip(self.columns(query.terms), query.weights):
            score[held] += w * values
        return score[rows]

    def best(self, rows, scores, k):
        """The k best of rows as (score, doc_id), higher scores and lower ids first."""
        order = np.lexsort((self.by_id[rows], -scores))[:k]
        doc_ids = self.doc_ids.take(pa.array(rows[order])).to_pylist()
        return list(zip(scores[order].tolist(), doc_ids))


class Query:
    """Weights of an item, heaviest first, and the lengths of what follows each."""

    def __init__(self, terms, weights, size):
        order = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[order], weights[order]
        squares = np.cumsum(self.weights[::-1].astype(float) ** 2)[::-1]
        self.rest = np.sqrt(np.append(squares, 0.0))
        self.length = self.rest[0]
        self.size = size

    @property
    def dense(self):
        weights = np.zeros(self.size, np.int64)
        weights[self.terms] = self.weights
        return weights


def place(entry):
    score, doc_id = entry
    return (-score, doc_id is not None, 0 if doc_id is None else doc_id)


def searched(vectors, queries, k, thresholds=None):
    """The best k documents of every query in each partition of ``vectors``.

    ``vectors`` come longest first within a partition. ``thresholds`` are scores that k
    documents reach.
    """
    schema = StructType([StructField("query", LongType()), vectors.schema["doc_id"]])
    schema = schema.add("score", "long")
    target = arrow_schema(vectors.sparkSession, schema)

    def run(batches):
        given = np.zeros(len(queries)) if thresholds is None else np.array(thresholds, float)
        lowest = np.maximum(given, 1.0)
        lengths = np.array([q.length for q in queries])
        found = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                part = batch.slice(start, BUCKET)
                longest = pc.max(part.column(3)).as_py()
                open_queries = np.nonzero(lengths * longest * (1 + MARGIN) >= lowest)[0]
                if not len(open_queries):
                    continue
                bucket = Bucket(part)
                for q in open_queries.tolist():
                    rows = bucket.survivors(queries[q], lowest[q])
                    scores = bucket.scores(queries[q], rows)
                    kept = scores >= lowest[q]
                    if not kept.any():
                        continue
                    best = found.get(q, []) + bucket.best(rows[kept], scores[kept], k)
                    best.sort(key=place)
                    found[q] = best = best[:k]
                    if len(best) == k:
                        lowest[q] = max(lowest[q], best[-1][0])
        rows = [(q, doc_id, score) for q, best in found.items() for score, doc_id in best]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target
        )

    return vectors.mapInArrow(run, schema)


def top(found, k):
    """The best k of all partitions with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def rank_block(scratch, docs, items, k):
    """key, rank, doc_id and score for a block of items."""
    spark = docs.sparkSession
    vectors = scratch.stage(frequencies(docs, items.number), "frequencies")
    with_terms = F.count(F.when(F.col("n") > 0, 1))
    documents, terms = vectors.agg(with_terms, F.sum("n")).first()
    terms = terms or 1  # only without documents
    df = document_frequencies(vectors, len(items.number))
    weights = np.array([weight(documents, int(n)) for n in df], np.int64)
    queries = [
        Query(ids, repeats * weights[ids], len(weights))
        for ids, repeats in zip(items.terms, items.repeats)
    ]
    keys = spark.createDataFrame(list(enumerate(items.keys)), "query long, key string")
    vectors = impacts(vectors, documents, terms)
    head = vectors.orderBy(F.desc("length")).limit(BUCKET)
    thresholds = [0] * len(queries)
    last = top(searched(head, queries, k), k).where(F.col("rank") == k)
    for query, score in last.select("query", "score").collect():
        thresholds[query] = score
    # Copies have one length; their ids deal them over several ranges.
    ordered = vectors.repartitionByRange(F.desc("length"), F.xxhash64("doc_id"))
    ordered = ordered.sortWithinPartitions(F.desc("length"))
    found = top(searched(ordered, queries, k, thresholds), k)
    return found.join(keys, "query").select("key", "rank", "doc_id", "score")


def ranked(scratch, docs, items, k):
    """item_id, rank, doc_id and score of the k best documents of every item.

    The result is staged in ``scratch``.
    """
    docs = docs.select("doc_id", "text")
    key = F.sha2(F.col("text").cast("binary"), 256).alias("key")
    items = items.where(F.col("text").isNotNull()).select("item_id", key, "text")
    items = scratch.stage(items.dropDuplicates(["item_id", "key"]), "items")
    texts = items.dropDuplicates(["key"]).select("key", F.col("text").cast("binary").alias("data"))
    size = texts.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("key"), F.lit(max(blocks, 1)))
    results = None
    for number in range(blocks):
        held = Items(texts.where(block == number).collect())
        if held.keys:
            found = scratch.stage(rank_block(scratch, docs, held, k), "ranked")
            results = found if results is None else results.unionByName(found)
    if results is None:
        fields = [items.schema["item_id"], StructField("rank", IntegerType())]
        fields += [docs.schema["doc_id"], StructField("score", LongType())]
        return docs.sparkSession.createDataFrame([], StructType(fields))
    return scratch.stage(
        results.join(items.select("item_id", "key"), "key").select(
            "item_id", "rank", "doc_id", "score"
        ),
        "items-ranked",
    )
