"""Packing documents along a Hilbert curve through their hashed token vectors.

Every document becomes token ids and a point: a hashed bag of tokens, projected to
a few dimensions by fixed random signs. Documents are range-sorted by the Hilbert
key of their point, so that neighbours on the curve have similar tokens, and each
range is cut into full sequences. What remains at the end of a range is cut at
powers of two, which need no padding.

Defined cases: null text counts as empty and becomes the end token alone; equal
keys are ordered by a hash of doc_id, doc_id and text, so a large group of copies is
spread over ranges; repeated rows are packed one by one; other columns are
ignored; an empty table gives no piece.
"""

import json
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourgrid.llm.common import arrow_schema, held, map_rows
from hourgrid.llm.token_counts import (
    CACHED_LENGTH,
    TOKEN_WORDS,
    Remembered,
    byte_symbols,
    words_stand_alone,
)
from hourgrid.llm.token_counts import PIECES as PIECE

BUCKETS = 256
DIMENSIONS = 4
BITS = 8
RANGE_TOKENS = 64_000_000
STAGED = "doc_id long, curve long, tie int, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
    "offset long, sequence_length long, ids binary"
)


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes.

    Of a text whose words stand alone, runs of short words are encoded at once by the
    faster of two libraries that share the vocabulary, if its ids ascend with the merge
    ranks, as that library expects; otherwise its words are remembered. The first word,
    long words and other texts go to the tokenizer.
    """

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()
        ]
        self.fast = ranked_encoding(path)
        self.word = Remembered(self.after_space, "packing", TOKEN_WORDS)

    def encode(self, text):
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def after_space(self, word):
        return self.encode(" " + word)

    def runs(self, words):
        """Ids of words that follow a space each; a long word is a run of its own."""
        for long, run in groupby(words, lambda word: len(word) > CACHED_LENGTH):
            if long:
                yield from map(self.after_space, run)
            else:
                yield packed(self.fast.encode_ordinary(" " + " ".join(run)))

    def of(self, text):
        if (
            not text
            or not words_stand_alone(text)
            or any(special in text for special in self.specials)
        ):
            return self.encode(text)
        first, *rest = text.split(" ")
        if self.fast is None:
            return self.encode(first) + b"".join(map(self.word.__getitem__, rest))
        if not rest:
            return self.encode(first)
        if max(map(len, rest)) <= CACHED_LENGTH:
            return self.encode(first) + packed(self.fast.encode_ordinary(text[len(first) :]))
        return self.encode(first) + b"".join(self.runs(rest))


def packed(ids):
    return array("I", ids).tobytes()


def ranked_encoding(path):
    """The vocabulary as ranks of byte strings, or None if ids do not follow the merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary[left + right] for left, right in pairs]
    if made != sorted(made) or (made and made[0] < 256):
        return None
    byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
    ranks = {
        bytes(map(byte_of.__getitem__, token)): rank for token, rank in vocabulary.items()
    }
    return tiktoken.Encoding("words", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})


def word_ids(path):
    return held("packing", path, lambda: WordIds(path))


def signs():
    """A fixed matrix of -1 and 1, one row per dimension of the curve."""
    return np.random.default_rng(20240229).choice([-1.0, 1.0], (DIMENSIONS, BUCKETS))


def points(ids):
    """Coordinates of one document: its hashed, damped token counts, projected."""
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    counts = np.sqrt(np.bincount(bucket, minlength=BUCKETS)[:BUCKETS])
    length = np.linalg.norm(counts) or 1.0
    unit = signs_once() @ (counts / length)
    # Projections of unit vectors lie within about 3 standard deviations of 1.
    cell = (unit + 3.0) / 6.0 * (1 << BITS)
    return np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64)


@lru_cache(maxsize=1)
def signs_once():
    return signs()


def hilbert_keys(cells, bits=BITS):
    """Position on the Hilbert curve of each row of grid coordinates.

    Works from the high bit down: cells are reflected or exchanged so that every
    sub-cube is entered where the one before was left (Skilling's transform).
    """
    axes = np.array(cells, np.int64).T.copy()
    count = len(axes)
    level = 1 << (bits - 1)
    while level > 1:
        mask = level - 1
        for i in range(count):
            inside = (axes[i] & level) != 0
            swapped = np.where(inside, 0, (axes[0] ^ axes[i]) & mask)
            axes[0] = np.where(inside, axes[0] ^ mask, axes[0] ^ swapped)
            axes[i] ^= swapped
        level >>= 1
    for i in range(1, count):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where(axes[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    axes ^= turn
    keys = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | ((axis >> bit) & 1)
    return keys


def id_type(tokenizer, end_id):
    """16 bits while ids move, if the vocabulary allows it."""
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenised(docs, tokenizer, end_id):
    """doc_id, curve key, number of tokens and ids of every document."""
    narrow = id_type(tokenizer, end_id)

    def rows(batch):
        encode = word_ids(tokenizer).of
        end = packed([end_id])
        ids = [np.frombuffer(encode(t or "") + end, "<u4") for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "curve": hilbert_keys([points(i) for i in ids]),
            "tie": batch["tie"],
            "n_tokens": [len(i) for i in ids],
            "ids": [i.astype(narrow).tobytes() for i in ids],
        }

    keyed = docs.select("doc_id", "text", F.hash("doc_id").alias("tie"))
    return map_rows(keyed, rows, STAGED, slice_rows=128)


def sequence_lengths(total, limit):
    """Lengths that hold ``total`` tokens without padding: full ones, then powers of two."""
    lengths = [limit] * (total // limit)
    rest = total % limit
    return lengths + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(scratch, docs, tokenizer, end_id, limit=2048):
    """One row per piece; all pieces of a sequence lie in one task, in order.

    The ids are written once; the ranges are sampled from the narrow columns of
    that table and only then do ids move, once.
    """
    staged = scratch.stage(tokenised(docs, tokenizer, end_id), "ids", "zstd")
    total = staged.agg(F.sum("n_tokens")).first()[0] or 0
    spark = docs.sparkSession
    ranges = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS)
    )
    narrow = id_type(tokenizer, end_id)
    ordered = staged.repartitionByRange(
        ranges, "curve", "tie", "doc_id"
    ).sortWithinPartitions("curve", "tie", "doc_id", "n_tokens", "ids")
    target = arrow_schema(spark, PIECES)

    def cut(batches):
        """Fill sequences one after the other; what is left over waits for the end."""
        next_id = TaskContext.get().partitionId() << 40
        open_pieces, room = [], limit
        for batch in batches:
            columns = batch.select(["doc_id", "n_tokens", "ids"]).to_pydict()
            out = []
            for doc_id, n, blob in zip(columns["doc_id"], columns["n_tokens"], columns["ids"]):
                blob = np.frombuffer(blob, narrow).astype("<u4").tobytes()
                start = 0
                while start < n:
                    length = min(n - start, room)
                    piece = blob[4 * start : 4 * (start + length)]
                    open_pieces.append((doc_id, start, length, n, piece))
                    start += length
                    room -= length
                    if room == 0:
                        out += placed(open_pieces, next_id, limit)
                        open_pieces, room = [], limit
                        next_id += 1
            if out:
                yield record(out)
        out = []
        for length in sequence_lengths(limit - room, limit):
            taken, open_pieces = split_pieces(open_pieces, length)
            out += placed(taken, next_id, length)
            next_id += 1
        if out:
            yield record(out)

    def record(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target
        )

    return ordered.mapInArrow(cut, PIECES)


def placed(pieces, sequence, length):
    """Rows of one sequence, with offsets from 0 on."""
    rows, offset = [], 0
    for doc_id, start, size, n, ids in pieces:
        rows.append((doc_id, start, size, n, sequence, offset, length, ids))
        offset += size
    return rows


def split_pieces(pieces, length):
    """The first ``length`` tokens of some pieces, and the pieces of the rest."""
    taken, rest = [], []
    for doc_id, start, size, n, ids in pieces:
        part = min(size, length)
        if part:
            taken.append((doc_id, start, part, n, ids[: 4 * part]))
        if part < size:
            rest.append((doc_id, start + part, size - part, n, ids[4 * part :]))
        length -= part
    return taken, rest


def digests(pieces):
    """Pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
