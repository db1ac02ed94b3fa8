"""SimHash fingerprints of documents and all pairs of them within a Hamming radius.

1. The terms of a text are its pairs of neighbouring words, the start and the end of the
   text being words too, A-Z lower-cased. A term that occurs n times votes with weight
   sqrt(n); its hash tells for each of BITS bits whether it votes for or against, and
   the fingerprint has the bits that won. The share of equal bits of two fingerprints
   is their likeness: about a half for unrelated texts, 1 for equal ones.
2. Fingerprints within a radius of r bits agree in at least one of r + 1 blocks. So the
   distinct fingerprints are listed in r + 1 tables, one by each block, and compared
   only with those that share the table's block. A pair counts in the first table in
   which it meets. Long lists are cut into chunks and each pair of chunks is one task,
   which returns counts, never pairs.

Texts are hashed as arrays: a running sum of byte times power of an odd number gives
the hash of every word as a difference of two places. Words come in runs of CHUNK_BYTES,
so memory stays at a small multiple of the longest text.

The links inside one large group of different near copies grow with its square, and so
does the time to count them; rows moved grow with that square over LIST.

Defined cases: null, empty and blank texts have the fingerprint of all zero bits;
documents of one text share one fingerprint, whatever their ids; null ids are documents
like any other, and a class of them alone has a null id; repeated rows count each;
without documents the result is empty; other columns are ignored.
"""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hourgrid.llm.common import arrow_schema

BITS = 256
WORDS64 = BITS // 64
BYTES = BITS // 8
CHUNK_BYTES = 1 << 20  # bytes of text hashed at once; longer words go to another hash
LIST = 4096  # fingerprints of a chunk of a list
TILE = 256  # rows of a chunk compared at once
SLICE_ROWS = 256

# Fixed values of the mixing function (splitmix64) and of the running sums.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
BASE = 0x9E3779B97F4A7C15
START, END = np.uint64(1), np.uint64(2)

BLANKS = b" \t\n\x0b\x0c\r"
BLANK_BYTES = [bytes([b]) for b in BLANKS]
NEXT_BLANK = re.compile(b"[" + BLANKS + b"]")
BLANK = np.isin(np.arange(256), [*BLANKS])
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1


def mixed(values):
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(MIX[0])
    values ^= values >> np.uint64(27)
    values *= np.uint64(MIX[1])
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as long as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, size):
        if len(cls.up) < size:
            inverse = pow(BASE, -1, 1 << 64)
            cls.up, cls.down = (
                np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)))
                for b in (BASE, inverse)
            )
        return cls.up, cls.down


def hashed_words(data):
    """Hash and start of every word of some UTF-8 bytes."""
    codes = np.frombuffer(b" " + data + b" ", np.uint8)
    edges = np.diff(BLANK[codes].astype(np.int8))
    start, end = np.nonzero(edges < 0)[0] + 1, np.nonzero(edges > 0)[0] + 1
    up, down = Powers.of(len(codes))
    sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])
    return mixed((sums[end - 1] - sums[start - 1]) * down[start]), start - 1


def word_runs(data):
    """Hashes of the words of one long text, in runs."""
    at = 0
    while at < len(data):
        end = at + CHUNK_BYTES
        if end < len(data):
            end = max(data.rfind(blank, at, end) for blank in BLANK_BYTES)
        if end > at:
            yield hashed_words(data[at:end])[0]
        else:  # a blank, if any, and a word to the end of the run or beyond
            start = at + bool(BLANK[data[at]])
            stop = NEXT_BLANK.search(data, start)
            end = stop.start() if stop else len(data)
            word = data[start:end]
            if len(word) > CHUNK_BYTES:
                yield np.array([xxhash.xxh64_intdigest(word)], np.uint64)
            else:
                yield hashed_words(word)[0]
        at = end


def word_hashes(texts):
    """Hashes of the words of some texts (lower-cased bytes) and the text of each."""
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        hashes = np.concatenate(list(word_runs(texts[0])))
        return hashes, np.zeros(len(hashes), np.int64)
    hashes, start = hashed_words(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, start, side="right")


def terms(texts):
    """Hash and text of every pair of neighbouring words."""
    words, text = word_hashes(texts)
    if not len(words):
        return words, text
    begins = np.append(True, text[1:] != text[:-1])
    last = np.append(begins[1:], True)
    before = np.where(begins, START, np.append(START, words[:-1]))
    three = np.uint64(3)
    pairs = np.append(mixed(before * three + words), mixed(words[last] * three + END))
    return pairs, np.append(text, text[last])


def votes_of(texts):
    """The fingerprints of some texts together."""
    hashes, text = terms(texts)
    step = np.uint64(MIX[2])
    _, first, counts = np.unique(
        mixed(hashes ^ mixed((text.astype(np.uint64) + START) * step)),
        return_index=True,
        return_counts=True,
    )
    hashes, text, weights = hashes[first], text[first], np.sqrt(counts)
    votes = np.zeros((len(texts), BITS))
    for word in range(WORDS64):
        salt = np.uint64((word + 1) * MIX[2] % (1 << 64))
        bits = mixed(hashes + salt).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(text * 256 + bits[:, byte], weights, len(texts) * 256)
            at = (word * 8 + byte) * 8
            votes[:, at : at + 8] = seen.reshape(-1, 256) @ SIGNS
    # Sums of roots differ in their last digits with the order of the terms.
    return np.packbits(votes > 1e-9, axis=1)


def fingerprints_of(texts):
    """One row of BYTES bytes for every text (str)."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    groups, held = [[]], 0
    for one in data:
        if groups[-1] and held + len(one) > CHUNK_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(one)
        held += len(one) + 1
    return np.concatenate([votes_of(group) for group in groups if group])


def likeness(left, right):
    """Share of equal bits, row by row."""
    return 1 - np.bitwise_count(left ^ right).sum(axis=1) / BITS


def fingerprints(docs):
    """doc_id and fingerprint (binary) of every document."""
    schema = StructType([docs.schema["doc_id"]]).add("fingerprint", "binary")
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                prints = fingerprints_of([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([p.tobytes() for p in prints], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- all fingerprints within a radius


def blocks(radius):
    """Start and length in bytes of each of radius + 1 blocks."""
    if not 0 <= radius < BYTES:
        raise ValueError(f"the radius must be at least 0 and below {BYTES}")
    cuts = [BYTES * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def near_classes(scratch, prints, radius):
    """fingerprint, class_id, class_size and n_near of every distinct fingerprint.

    ``prints`` has doc_id and fingerprint. ``class_id`` is the smallest doc_id,
    ``n_near`` the number of other documents within ``radius`` bits, class mates too.
    """
    classes = scratch.stage(
        prints.groupBy("fingerprint").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
        ),
        "classes",
    )
    spans = blocks(radius)
    entry = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("list"), F.substring("fingerprint", a + 1, n).alias("key"))
                for t, (a, n) in enumerate(spans)
            ]
        )
    )
    entries = classes.select("fingerprint", "class_size", entry.alias("e"))
    entries = entries.select("fingerprint", "class_size", "e.*")
    sizes = entries.groupBy("list", "key").agg(F.count(F.lit(1)).alias("entries"))
    chunks = F.ceil(F.col("entries") / LIST).cast("int")
    chunk = F.pmod(F.xxhash64("fingerprint"), "chunks").cast("int")
    shared = (
        entries.join(sizes.where("entries > 1"), ["list", "key"])
        .withColumn("chunks", chunks)
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("low", F.least("chunk", "other"))
        .withColumn("high", F.greatest("chunk", "other"))
        .select("list", "key", "low", "high", "chunk", "fingerprint", "class_size")
    )

    def compare(rows):
        list_no, low, high = (int(rows[c].iloc[0]) for c in ("list", "low", "high"))
        prints = np.frombuffer(b"".join(rows["fingerprint"]), np.uint8).reshape(-1, BYTES)
        sizes, side = rows["class_size"].to_numpy(), rows["chunk"].to_numpy()
        first, second = side == low, side == high
        near = np.zeros(len(rows), np.int64)
        near[first] = counted(prints[first], prints[second], sizes[second], list_no)
        if low != high:
            near[second] = counted(prints[second], prints[first], sizes[first], list_no)
        elif list_no == 0:
            near -= sizes  # each has met itself
        met = near > 0
        return pd.DataFrame({"fingerprint": rows["fingerprint"][met], "near": near[met]})

    def counted(left, right, sizes, list_no):
        """Documents of ``right`` within the radius that no earlier list has counted."""
        total = np.zeros(len(left), np.int64)
        wide = right.view(np.uint64)
        for start in range(0, len(left), TILE):
            rows = left[start : start + TILE]
            distance = np.zeros((len(rows), len(right)), np.uint16)
            for i in range(WORDS64):
                distance += np.bitwise_count(rows.view(np.uint64)[:, i, None] ^ wide[None, :, i])
            a, b = np.nonzero(distance <= radius)
            fresh = np.ones(len(a), bool)
            for at, n in spans[:list_no]:
                fresh &= (rows[a, at : at + n] != right[b, at : at + n]).any(axis=1) | ~fresh
            total[start : start + TILE] = np.bincount(a[fresh], sizes[b[fresh]], len(rows))
        return total

    compared = shared.groupBy("list", "key", "low", "high").applyInPandas(
        compare, "fingerprint binary, near long"
    )
    near = compared.groupBy("fingerprint").agg(F.sum("near").alias("near"))
    n_near = F.coalesce("near", F.lit(0)) + F.col("class_size") - 1
    return classes.join(near, "fingerprint", "left").select(
        "fingerprint", "class_id", "class_size", n_near.alias("n_near")
    )


# ---- a trial: texts that end like the next document begins


def edited(text, following):
    """The last third of a text replaced by as much of the beginning of another."""
    size = len(text) // 3
    return text[: len(text) - size] + following[:size]


FIRST, LAST = 1, 2


def compared_rows(ids, texts, following):
    """Columns of the trial for texts and the text that follows each."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    place = {t: i for i, t in enumerate(dict.fromkeys([*texts, *following, *changed]))}
    prints = fingerprints_of(list(place))
    own, after, new = (prints[[place[t] for t in ts]] for ts in (texts, following, changed))
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).digest() for t in changed],
        "fingerprint": [p.tobytes() for p in own],
        "edited_fingerprint": [p.tobytes() for p in new],
        "near_edited": likeness(own, new),
        "near_next": likeness(own, after),
    }


def trial(scratch, docs):
    """Each document beside the next one by descending doc_id, null last, and an edit.

    Rows of one doc_id go by a hash of their text. Documents are sorted over the whole
    table; the first and last text of every range are kept aside, and each range's last
    row then meets the first of the next range.
    """
    spark = docs.sparkSession
    schema = (
        StructType([docs.schema["doc_id"]])
        .add("n_chars", "long")
        .add("edited_sha256", "binary")
        .add("fingerprint", "binary")
        .add("edited_fingerprint", "binary")
        .add("near_edited", "double")
        .add("near_next", "double")
    )
    wide = StructType([*schema.fields]).add("part", "integer").add("edge", "integer")
    wide = wide.add("text", "string")
    target = arrow_schema(spark, wide)
    bare = arrow_schema(spark, schema)

    def batch_of(columns, rows):
        nothing = [None] * rows
        return pa.RecordBatch.from_arrays(
            [pa.array(columns.get(f.name, nothing), f.type) for f in target], schema=target
        )

    def edge(part, kind, doc_id, text):
        return batch_of({"doc_id": [doc_id], "part": [part], "edge": [kind], "text": [text]}, 1)

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                ids = rows.column(0).to_pylist()
                texts = [t or "" for t in rows.column(1).to_pylist()]
                if held is None:
                    yield edge(part, FIRST, ids[0], texts[0])
                else:
                    ids.insert(0, held[0])
                    texts.insert(0, held[1])
                held = ids.pop(), texts[-1]
                if ids:
                    yield batch_of(compared_rows(ids, texts[:-1], texts[1:]), len(ids))
        if held is not None:
            yield edge(part, LAST, *held)

    def run_edges(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = [c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns]
                found = compared_rows(*columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[f.name], f.type) for f in bare], schema=bare
                )

    keys = [F.desc_nulls_last("doc_id"), F.col("tie")]
    sorted_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    sorted_docs = sorted_docs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = scratch.stage(sorted_docs.select("doc_id", "text").mapInArrow(run, wide), "trial")
    # Ranges in order: one number a task of the sort.
    ends = rows.where(F.col("edge") == LAST).select("part").orderBy("part")
    parts = [row.part for row in ends.collect()]
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    first = rows.where(F.col("edge") == FIRST).select(
        F.col("part").alias("next"), F.col("text").alias("following")
    )
    last = rows.where(F.col("edge") == LAST).select("part", "doc_id", "text")
    edges = last.join(follow, "part").join(first, "next").select("doc_id", "text", "following")
    inner = rows.where(F.col("edge").isNull()).select(*schema.fieldNames())
    return inner.unionByName(edges.mapInArrow(run_edges, schema))
