"""Line dedup that can be taken back: sharded cuckoo filters over exact counts.

The index keeps, for every line key, the exact number of documents that hold it, as
a ledger of additions and subtractions. One cuckoo filter per shard holds the keys at
or above the threshold; inserting documents adds keys that rise to it, deleting
documents removes keys that fall below it. To drop lines, the keys of the documents
stream past the filter of their shard; only what it lets through is checked against
the exact counts, so a false positive never drops a line.

The index lies in its folder and outlives its process. A change writes its part of the
ledger and new filters and then one commit that names what is valid; a new object goes on
from the last commit, and what a broken change left behind is overwritten. Every COMPACT
parts the ledger is added up into one.

A key is a line without ASCII white space at both ends, A-Z lower-cased; keys shorter
than ``min_length`` code points never count. Keys travel as 128-bit hashes.

Defined cases: null or empty text is one empty line, which stays; a line that occurs
twice in one document counts once but all its copies are dropped; repeated rows count
as separate documents; deleting documents that were not inserted raises when the
index is checked; columns other than doc_id and text are ignored; an empty table
changes nothing.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hourgrid.llm.common import arrow_schema, map_rows, text_bytes
from hourgrid.session import write_and_read
from hourgrid.sources import paths

SLOTS = 4
KICKS = 200
SALTS = 8
COMPACT = 8
STATE = "changes array<string>, version int, threshold long, min_length long, shards long"
KEY = ("shard", "high", "low")


def line_keys(data, min_length=1):
    """The hash (two signed 64-bit numbers) of each line of some UTF-8 bytes, or None."""
    keys = []
    for line in data.split(b"\n"):
        key = line.strip().lower()  # bytes: ASCII white space and A-Z only
        if len(key) < min_length or (
            min_length > 1 and len(key.decode("utf-8", "replace")) < min_length
        ):
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(key))
    return keys


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a full block is followed by another."""

    def __init__(self, blocks=(), capacity=64):
        self.blocks = list(blocks)
        self.capacity = capacity

    @classmethod
    def load(cls, blob):
        blocks, at = [], 0
        while at < len(blob):
            buckets = int.from_bytes(blob[at : at + 8], "little")
            size = buckets * SLOTS * 2
            slots = np.frombuffer(blob, "<u2", buckets * SLOTS, at + 8)
            blocks.append(slots.reshape(buckets, SLOTS).copy())
            at += 8 + size
        return cls(blocks)

    def dump(self):
        return b"".join(len(b).to_bytes(8, "little") + b.tobytes() for b in self.blocks)

    @staticmethod
    def parts(highs):
        """Fingerprint (never 0) and first bucket number, before masking, of each key."""
        bits = np.asarray(highs, np.int64).view(np.uint64)
        prints = (bits >> np.uint64(48)).astype(np.int64)
        return np.where(prints == 0, 1, prints), (bits & np.uint64((1 << 40) - 1)).astype(np.int64)

    @staticmethod
    def other(bucket, prints, buckets):
        return bucket ^ ((prints * 0x5BD1E995 + 1) & (buckets - 1))

    def insert(self, prints, place):
        if not self.blocks:
            buckets = 1 << int(self.capacity / (SLOTS * 0.8)).bit_length()
            self.blocks.append(np.zeros((buckets, SLOTS), "<u2"))
        block = self.blocks[-1]
        buckets = len(block)
        bucket = place & (buckets - 1)
        for turn in range(KICKS):
            for at in (bucket, self.other(bucket, prints, buckets)) if turn == 0 else (bucket,):
                free = np.flatnonzero(block[at] == 0)
                if len(free):
                    block[at, free[0]] = prints
                    return
            slot = turn % SLOTS
            prints, block[bucket, slot] = int(block[bucket, slot]), prints
            bucket = self.other(bucket, prints, buckets)
        # The one left over goes to the same bucket of a further block of that size.
        self.blocks.append(np.zeros((buckets, SLOTS), "<u2"))
        self.blocks[-1][bucket, 0] = prints

    def remove(self, prints, place):
        for block in reversed(self.blocks):
            bucket = place & (len(block) - 1)
            for at in (bucket, self.other(bucket, prints, len(block))):
                found = np.flatnonzero(block[at] == prints)
                if len(found):
                    block[at, found[0]] = 0
                    return
        raise KeyError("removed a key that was never inserted")

    def may_hold(self, highs):
        prints, places = self.parts(highs)
        hit = np.zeros(len(prints), bool)
        for block in self.blocks:
            bucket = places & (len(block) - 1)
            for at in (bucket, self.other(bucket, prints, len(block))):
                hit |= (block[at] == prints[:, None]).any(axis=1)
        return hit


class LineIndex:
    """Reference counts and filters of a growing and shrinking set of documents."""

    def __init__(self, spark, folder, threshold, min_length=1, shards=256):
        self.spark, self.folder = spark, folder
        self.threshold, self.min_length, self.shards = threshold, min_length, shards
        self.changes, self.version, self.number = [], 0, 0
        self._open()

    def _open(self):
        """Go on from the last commit in the folder, if there is one."""
        commits = paths.list_folders(self.spark, f"{self.folder}/commits")
        for name in reversed(commits):
            last = self.spark.read.schema(STATE).parquet(f"{self.folder}/commits/{name}").first()
            if last is None:  # a commit that was not finished
                continue
            if (last.threshold, last.min_length, last.shards) != (
                self.threshold,
                self.min_length,
                self.shards,
            ):
                raise ValueError("the index was made with other parameters")
            self.changes, self.version = list(last.changes), last.version
            self.number = int(name)
            return

    def _commit(self, changes, version):
        """Make a state valid as a whole; then drop what the last two do not need."""
        old = set(self.changes)
        path = f"{self.folder}/commits/{self.number + 1:08d}"
        paths.drop_folder(self.spark, path)
        named = F.array(*[F.lit(name) for name in changes])
        self.spark.range(1).select(
            named.alias("changes"),
            F.lit(version).alias("version"),
            *[
                F.lit(value).cast("long").alias(name)
                for name, value in (
                    ("threshold", self.threshold),
                    ("min_length", self.min_length),
                    ("shards", self.shards),
                )
            ],
        ).write.parquet(path)
        needed = {*old, *changes, f"filters-{version}", f"filters-{self.version}", "commits"}
        self.changes, self.version, self.number = list(changes), version, self.number + 1
        for name in paths.list_folders(self.spark, self.folder):
            if name not in needed and name.startswith(("change-", "filters-")):
                paths.drop_folder(self.spark, f"{self.folder}/{name}")
        for name in paths.list_folders(self.spark, f"{self.folder}/commits"):
            if int(name) < self.number - 1:
                paths.drop_folder(self.spark, f"{self.folder}/commits/{name}")

    def compact(self):
        """Add the ledger up into one part; counts and filters stay as they are."""
        name = f"change-{self.number + 1}"
        paths.drop_folder(self.spark, f"{self.folder}/{name}")
        self.counts().write.parquet(f"{self.folder}/{name}")
        self._commit([name], self.version)

    def insert(self, docs):
        self._change(docs, 1)

    def delete(self, docs):
        """Take back documents, given as they were inserted."""
        self._change(docs, -1)

    def keys(self, docs):
        """One row per document and distinct line key: doc_id, shard, high, low."""
        shards, min_length = self.shards, self.min_length

        def rows(batch):
            out = {"doc_id": [], "shard": [], "high": [], "low": []}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                keys = {*line_keys(text_bytes(text), min_length)} - {None}
                for key in keys:
                    high = int.from_bytes(key[:8], "little", signed=True)
                    out["doc_id"].append(doc_id)
                    out["shard"].append(key[8] % shards)
                    out["high"].append(high)
                    out["low"].append(int.from_bytes(key[8:], "little", signed=True))
            return out

        return map_rows(
            docs.select("doc_id", "text"), rows, "doc_id long, shard int, high long, low long"
        )

    def counts(self):
        """The exact number of documents of every key that has any."""
        ledger = self._ledger(self.changes)
        if ledger is None:
            return self.spark.createDataFrame([], "shard int, high long, low long, n long")
        if len(self.changes) == 1:
            return ledger
        return ledger.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")

    def check(self):
        """Raise if more documents with some key were deleted than inserted."""
        if not self.counts().where("n < 0").isEmpty():
            raise ValueError("deleted documents that were not inserted")

    def _ledger(self, changes):
        schema = "shard int, high long, low long, n long"
        if not changes:
            return None
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{c}" for c in changes])

    def _filters(self):
        schema = "shard int, filter binary"
        if self.version == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/filters-{self.version}")

    def _change(self, docs, sign):
        number = self.number + 1
        name = f"change-{number}"
        for leftover in (name, f"filters-{number}"):
            paths.drop_folder(self.spark, f"{self.folder}/{leftover}")
        delta = write_and_read(
            self.keys(docs)
            .groupBy(*KEY)
            .agg((F.count(F.lit(1)) * sign).cast("long").alias("n")),
            f"{self.folder}/{name}",
        )
        before = self._ledger(self.changes)
        after = F.col("n")
        if before is None:
            moved = delta.withColumn("was", F.lit(0).cast("long"))
        else:
            was = before.join(delta.select(*KEY), list(KEY), "left_semi")
            was = was.groupBy(*KEY).agg(F.sum("n").alias("was"))
            moved = delta.join(was, list(KEY), "left").na.fill(0, ["was"])
        after = F.col("was") + F.col("n")
        rises = (F.col("was") < self.threshold) & (after >= self.threshold)
        falls = (F.col("was") >= self.threshold) & (after < self.threshold)
        moves = moved.where(rises | falls).select(
            "shard", "high", F.when(rises, 1).otherwise(-1).alias("step")
        )
        self._update(moves, f"{self.folder}/filters-{number}")
        self._commit([*self.changes, name], number)
        if len(self.changes) >= COMPACT:
            self.compact()

    def _update(self, moves, path):
        """Apply rises and falls to the filter of each shard, one shard at a time."""
        old = self._filters().select(
            "shard", F.lit(0).cast("long").alias("high"), F.lit(0).alias("step"), "filter"
        )
        stream = (
            old.unionByName(moves.withColumn("filter", F.lit(None).cast("binary")))
            .repartition(self.shards, "shard")
            .sortWithinPartitions("shard", "step", "high")
        )
        # Falls (-1) come first, then the stored filter (0); both wait for the filter.
        schema = "shard int, filter binary"
        target = arrow_schema(self.spark, schema)

        def run(batches):
            shard, current, falls, rises = None, None, [], []

            def finished():
                table = current or CuckooFilter(capacity=max(64, len(rises)))
                for apply, highs in ((table.remove, falls), (table.insert, rises)):
                    for p, at in zip(*map(np.ndarray.tolist, table.parts(highs))):
                        apply(p, at)
                return pa.RecordBatch.from_pydict(
                    {"shard": [shard], "filter": [table.dump()]}, schema=target
                )

            for batch in batches:
                for row in zip(*batch.to_pydict().values()):
                    if row[0] != shard:
                        if shard is not None:
                            yield finished()
                        shard, current, falls, rises = row[0], None, [], []
                    if row[2] == 0:
                        current = CuckooFilter.load(row[3])
                    else:
                        (rises if row[2] > 0 else falls).append(row[1])
            if shard is not None:
                yield finished()

        stream.mapInArrow(run, schema).write.parquet(path)

    def suspects(self, keys):
        """The rows of ``keys`` that the filters let through.

        A shard's rows are spread over several tasks, each with its own copy of the
        filter, which sorts before them; so a very frequent line is no hot task, and
        a task holds one filter and one batch.
        """
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        nothing = F.lit(0).cast("long")
        filters = self._filters().select(
            "shard", copies, F.lit(0).alias("kind"), "filter",
            *[nothing.alias(c) for c in ("doc_id", "high", "low")],
        )
        rows = keys.select(
            "shard", salt.alias("salt"), F.lit(1).alias("kind"),
            F.lit(None).cast("binary").alias("filter"), "doc_id", "high", "low",
        )
        stream = (
            filters.unionByName(rows)
            .repartition("shard", "salt")
            .sortWithinPartitions("shard", "salt", "kind")
        )
        schema = "doc_id long, shard int, high long, low long"
        target = arrow_schema(self.spark, schema)

        def run(batches):
            group, current = None, None
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                salts = batch.column("salt").to_numpy()
                kind = batch.column("kind").to_numpy()
                turns = (np.diff(shard) != 0) | (np.diff(salts) != 0) | (np.diff(kind) != 0)
                ends = [*(np.flatnonzero(turns) + 1), batch.num_rows]
                start = 0
                for end in map(int, ends):
                    if start == end:
                        continue
                    here = shard[start], salts[start]
                    if kind[start] == 0:
                        group = here
                        current = CuckooFilter.load(batch.column("filter")[start].as_py())
                    elif group == here:
                        part = batch.slice(start, end - start).select(target.names)
                        hit = current.may_hold(part.column("high").to_numpy())
                        if hit.any():
                            yield part.filter(pa.array(hit)).cast(target)
                    start = end

        return stream.mapInArrow(run, schema)

    def dropped_keys(self, docs):
        """doc_id and the keys to drop there, as one binary of 16 bytes each."""
        heavy = self.counts().where(F.col("n") >= self.threshold).select(*KEY)
        found = self.suspects(self.keys(docs)).join(heavy, list(KEY), "left_semi")
        pair = F.struct("high", "low")
        return found.groupBy("doc_id").agg(F.collect_set(pair).alias("drop"))

    def drop_lines(self, docs):
        """One row per document: doc_id, text without the lines to drop, and counts."""
        min_length = self.min_length
        drop = self.dropped_keys(docs).withColumnRenamed("doc_id", "id")
        marked = docs.select("doc_id", "text").join(
            drop, F.col("doc_id").eqNullSafe(F.col("id")), "left"
        )

        def rows(batch):
            out = {name: [] for name in ("doc_id", "n_lines", "n_dropped", "text", "sha256")}
            for doc_id, text, drop in zip(batch["doc_id"], batch["text"], batch["drop"]):
                data = text_bytes(text)
                lines = data.split(b"\n")
                kept = lines
                if drop:
                    gone = {
                        key["high"].to_bytes(8, "little", signed=True)
                        + key["low"].to_bytes(8, "little", signed=True)
                        for key in drop
                    }
                    keys = line_keys(data, min_length)
                    kept = [line for line, key in zip(lines, keys) if key not in gone]
                data = b"\n".join(kept)
                out["doc_id"].append(doc_id)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["text"].append(data.decode("utf-8", "surrogatepass"))
                out["sha256"].append(hashlib.sha256(data).hexdigest())
            return out

        return map_rows(
            marked, rows, "doc_id long, n_lines long, n_dropped long, text string, sha256 string"
        )
