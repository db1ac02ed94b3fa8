"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A document's set is its distinct word shingles as 64-bit hashes; its sketch is the
   k smallest. Documents with the same set form a class, which has a number of its
   own from here on; no step goes by doc_id, which may be null or repeated.
2. Inverted lists of the sketch values give overlaps. Values in one list only are
   dropped, and so are documents that share fewer values than a linked pair must
   share; of the rest, each document is listed under its rarest values, enough of them
   that a linked pair meets at least once. Lists are kept apart by set size.
3. In each list every member is paired with one pivot, the member whose values are
   shared most, never with all others. Pairs pass the union-sketch estimate, then the
   exact Jaccard of the full sets. Linked classes form components.
4. Lists whose members still lie in several components are joined to clusters. A
   cluster is cut into blocks of bounded total set size, and each pair of blocks that
   sizes allow is one task, which counts all intersections at once as a product of
   incidence matrices and returns at most one link per two components it joins.

So every pair of one list that lies in different components is tried, and pairs
inside a component, whose link would change nothing, are not. No pair but a link
leaves a task of step 4; its work still grows with the square of a cluster.

Sketches can miss a linked pair only if fewer than SHARED of k sketch values are
shared, or the estimate falls below ESTIMATE; for pairs at the threshold each has a
chance of 7.8e-7 at most (binomial with k draws, 23 or fewer of 48 at 0.8).

Defined cases: words are runs without ASCII white space, A-Z lower-cased; fewer words
than a shingle has give the whole sequence as one; null, empty and blank texts have an
empty set and stand alone; rows are told apart by doc_id and text, so of each component
the row with the smallest doc_id, then the smallest digest of its text, is kept, with
its exact repetitions; a null doc_id is the smallest; other columns are ignored.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourgrid.llm.common import map_rows, text_bytes
from hourgrid.llm.token_counts import Remembered

SKETCH = 48
SHARED = 24
ESTIMATE = 0.5
BLOCK = 200_000
LEAST = 200
SLICE = 4096
ROW = "doc_id long, digest string, n long, class_high long, class_low long, sketch array<long>"

_word_hash = Remembered(xxhash.xxh3_64_intdigest, "near")


def mixed(values):
    """A fixed bijection of 64-bit numbers that spreads all bits (splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text, width):
    """Sorted distinct signed 64-bit hashes of the word shingles of a text."""
    words = text_bytes(text).lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(total)])
    return np.unique(total.view(np.int64))


def digest():
    """With doc_id, what tells the rows of a table of texts apart; null for null."""
    return F.md5(F.col("text").cast("binary"))


def sketches(docs, width):
    """doc_id, digest, set size, 128-bit hash of the whole set, and its bottom-k sketch."""

    def rows(batch):
        out = {name: [] for name in ("n", "class_high", "class_low", "sketch")}
        for text in batch["text"]:
            values = shingle_set(text, width)
            digest = xxhash.xxh3_128_digest(values.tobytes())
            out["n"].append(len(values))
            out["class_high"].append(int.from_bytes(digest[:8], "little", signed=True))
            out["class_low"].append(int.from_bytes(digest[8:], "little", signed=True))
            out["sketch"].append(values[:SKETCH])
        return {"doc_id": batch["doc_id"], "digest": batch["digest"], **out}

    columns = docs.select("doc_id", "text", digest().alias("digest"))
    return map_rows(columns, rows, ROW, slice_rows=128)


def listed(scratch, classes):
    """The inverted lists: (value, band of set size) with members and their rank."""
    values = scratch.stage(
        classes.select("id", "n", F.explode("sketch").alias("value")), "values"
    )
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = values.join(often, "value")
    # A linked pair shares at least this many sketch values.
    least = F.least(F.lit(SHARED), F.ceil(F.col("n") * 0.8))
    per_document = F.sort_array(F.collect_list(F.struct("often", "value")))  # k at most
    rarest = F.slice(
        "values", F.lit(1), F.greatest(F.size("values") - least + 1, F.lit(0)).cast("int")
    )
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9)
    entries = (
        shared.groupBy("id", "n")
        .agg(per_document.alias("values"), F.sum("often").alias("central"))
        .select("id", "n", "central", F.explode(rarest).alias("entry"))
        .select(
            "id", "n", "central", "entry.value", F.explode(F.array(band, band + 1)).alias("band")
        )
    )
    # What many others share most of, such as the original of many copies, comes first.
    order = Window.partitionBy("value", "band").orderBy(F.desc("central"), "id")
    ranked = entries.withColumn("rank", F.row_number().over(order)).drop("central")
    ranked = scratch.stage(ranked, "ranked")
    # A list of one has nobody to meet.
    several = ranked.where("rank = 2").select("value", "band")
    return scratch.stage(ranked.join(several, ["value", "band"], "left_semi"), "lists")


def paired(lists):
    """Each member with the first of its list, if their sizes allow a link."""
    pivots = lists.where("rank = 1").select(
        "value", "band", F.col("id").alias("a"), F.col("n").alias("pivot_n")
    )
    fits = F.least("pivot_n", "n") * 5 >= F.greatest("pivot_n", "n") * 4
    pairs = lists.where("rank > 1").join(pivots, ["value", "band"]).where(fits)
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def estimated(pairs, classes):
    """Pairs that share at least ESTIMATE of the k smallest values of their union."""
    side = classes.select("id", "sketch")
    both = pairs.join(side.toDF("a", "sketch_a"), "a").join(side.toDF("b", "sketch_b"), "b")
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    common = F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), "union")
    return (
        both.withColumn("union", union)
        .where(F.size(common) >= F.size("union") * ESTIMATE)
        .select("a", "b")
    )


def verified(pairs, sets):
    """Pairs of full sets with 100 * intersection >= 80 * union."""
    with_a = pairs.join(sets.toDF("a", "set_a"), "a")
    both = with_a.join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(common * 100 >= union * 80).select("a", "b")


def full_sets(docs, heads, width):
    """id and full shingle set of the documents that stand for classes (id, head)."""
    wanted = heads.select(
        "id", F.col("head.doc_id").alias("head_id"), F.col("head.digest").alias("head_digest")
    )
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (digest() == F.col("head_digest"))
    chosen = docs.select("doc_id", "text").join(wanted, same).select("id", "text")

    def rows(batch):
        sets = [shingle_set(text, width) for text in batch["text"]]
        return {"id": batch["id"], "shingles": sets}

    return map_rows(chosen, rows, "id long, shingles array<long>", slice_rows=64)


def components(scratch, links):
    """Smallest reachable id of every linked id, by alternating star contractions.

    Every round is written, so a lost executor repeats its own tasks only.
    """
    edges = scratch.stage(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # Larger neighbours of an id move to the smallest id it knows ...
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")
        )
        large = large.where("a <> b").distinct()
        # ... and an id with its smaller neighbours moves to the smallest of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array("a", "b")).alias("a")
        small = large.join(down, "a").select(ends, F.col("m").alias("b"))
        edges = scratch.stage(small.where("a <> b").distinct(), "links")
        centres = edges.select(F.col("b").alias("a"))
        twice = edges.groupBy("a").count().where("count > 1")
        if edges.join(centres, "a", "left_semi").isEmpty() and twice.isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def near_components(scratch, docs, width):
    """One row per document: doc_id, n_shingles, component_id, kept, stays.

    ``kept`` rows have the id of their component, ``stays`` is the one row of it that a
    filter leaves; they differ only where an id is repeated.
    """
    rows = near_rows(scratch, docs, width).drop("digest").withColumnRenamed("kept", "stays")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_rows(scratch, docs, width):
    """One row per document: doc_id, digest, n_shingles, component_id, kept."""
    rows = scratch.stage(sketches(docs, width), "sketches")
    by_class = ["n", "class_high", "class_low"]
    filled = rows.where("n > 0")
    classes = scratch.stage(
        filled.groupBy(*by_class)
        .agg(F.min(F.struct("doc_id", "digest")).alias("head"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    lists = listed(scratch, classes)
    heads = classes.select("id", "head").join(lists.select("id"), "id", "left_semi")
    sets = scratch.stage(full_sets(docs, heads, width), "sets")
    near = scratch.stage(estimated(paired(lists), classes), "near")
    links = scratch.stage(verified(near, sets), "found")
    reached = components(scratch, links)
    rest = scratch.stage(open_lists(lists, reached), "open")
    if not rest.isEmpty():
        links = links.union(scratch.stage(across(scratch, rest, sets), "across"))
        reached = components(scratch, links)
    labels = classes.join(reached, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    labels = labels.select(*by_class, "head", "component")
    first = labels.groupBy("component").agg(F.min("head").alias("first"))
    labels = labels.join(first, "component").select(*by_class, "first")
    grouped = filled.join(labels, by_class).select(
        "doc_id",
        "digest",
        "n",
        F.col("first.doc_id").alias("component_id"),
        F.struct("doc_id", "digest").eqNullSafe(F.col("first")).alias("kept"),
    )
    alone = rows.where("n = 0").select(
        "doc_id", "digest", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return grouped.union(alone).withColumnRenamed("n", "n_shingles")


def open_lists(lists, reached):
    """Members, with their components, of the lists that hold several of them."""
    labelled = lists.join(reached, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    several = (
        labelled.groupBy("value", "band")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"))
        .where((F.col("first") != F.col("last")))
        .select("value", "band")
    )
    return labelled.join(several, ["value", "band"], "left_semi")


def across(scratch, rest, sets):
    """Links between different components of the members of open lists.

    Lists with a member in common form a cluster. Its members, in order of set size,
    fill blocks of about BLOCK shingles (LEAST per member at least, which bounds their
    number); a pair of blocks is one task.
    """
    heads = rest.groupBy("value", "band").agg(F.min("id").alias("head"))
    edges = rest.join(heads, ["value", "band"]).select(
        F.col("id").alias("a"), F.col("head").alias("b")
    )
    clusters = components(scratch, edges).withColumnRenamed("component", "cluster")
    members = rest.select("id", "n", "component").distinct()
    members = members.join(clusters, "id", "left").withColumn(
        "cluster", F.coalesce("cluster", "id")
    )
    before = Window.partitionBy("cluster").orderBy("n", "id")
    cost = F.sum(F.greatest("n", F.lit(LEAST))).over(before)
    members = scratch.stage(
        members.withColumn("block", F.floor((cost - 1) / F.lit(BLOCK))), "members"
    )
    blocks = members.groupBy("cluster", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most")
    )
    first = blocks.select("cluster", F.col("block").alias("i"), F.col("most").alias("most_i"))
    second = blocks.select("cluster", F.col("block").alias("j"), F.col("least").alias("least_j"))
    tasks = (
        first.join(second, "cluster")
        .where("i <= j and most_i * 5 >= least_j * 4")
        .select("cluster", "i", "j")
    )
    # A block goes to each of its tasks once, also where it meets itself.
    sides = tasks.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = members.drop("n").join(sides, ["cluster", "block"]).join(sets, "id")
    return rows.groupBy("cluster", "i", "j").applyInPandas(joining, "a long, b long")


def joining(rows):
    """At most one link for every two components that two blocks join."""
    left = rows[rows["block"] == rows["i"]]
    right = rows[rows["block"] == rows["j"]]
    common = intersections(list(left["shingles"]), list(right["shingles"]))
    sizes = left["shingles"].map(len).to_numpy()[:, None] + right["shingles"].map(len).to_numpy()
    linked = common * 100 >= (sizes - common) * 80
    linked &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()
    found, parent = [], {}

    def root(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for x, y in np.argwhere(linked):
        one, other = root(left["component"].iat[x]), root(right["component"].iat[y])
        if one != other:
            parent[one] = other
            found.append((left["id"].iat[x], right["id"].iat[y]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def intersections(left, right):
    """Sizes of all intersections of two lists of sets, as a matrix.

    Only shingles of both sides count; they go through in slices, so that the
    incidence matrices stay small.
    """
    total = np.zeros((len(left), len(right)), np.int64)
    rows_l, values_l = flattened(left)
    rows_r, values_r = flattened(right)
    shared = np.intersect1d(values_l, values_r)
    for start in range(0, len(shared), SLICE):
        part = shared[start : start + SLICE]
        sides = []
        for rows, values, count in ((rows_l, values_l, len(left)), (rows_r, values_r, len(right))):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            matrix = np.zeros((count, len(part)), np.float32)
            matrix[rows[hit], at[hit]] = 1.0
            sides.append(matrix)
        total += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return total


def flattened(sets):
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return rows, np.concatenate(sets) if sets else np.empty(0, np.int64)
