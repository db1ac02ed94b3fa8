"""Benchmark items inside training documents: n-gram seeds, then local alignment.

The benchmark is a stated query set: it goes over all documents in blocks of a bounded
number of words, each broadcast once. Per block there is one pass over the texts. Seeds
are the word n-grams of an item that are rare among the block's items (in at most
SHARED_ITEMS different ones) and, of every STRETCH others in a row, the rarest; so a
phrase that many items share costs nothing, and yet every part of an item has seeds.
Rarity goes by items, never by documents: edited copies in many documents would make the
n-grams they lack the rarest, and those are the ones that do not find them. Seed hits give
places to look at. Where a run of the item's words could reach the score at all, a
Smith-Waterman alignment of the item with the surrounding words gives it: the alignment's
value divided by that of a full copy.

Texts never move between executors.

Defined cases: words are runs without white space, lower-cased and stripped of signs
at both ends; null and empty texts have no leak; items of fewer words than a seed has
cannot be told from chance and match nothing; a copy without GRAM words of the item in
a row, at a seed, gives no place to look at and is not found; repeated items each report; repeated
rows each report; an empty benchmark reports nothing; other columns are kept.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hourgrid.llm.token_counts import Remembered

GRAM = 3
SHARED_ITEMS = 8
STRETCH = 4
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5
BLOCK_WORDS = 200_000
SIGNS = ".,;:!?\"'()[]{}<>*#$%&|_-–—«»“”„¿¡`~/\\"
LEAKS = "array<struct<item_id:long,score:double,start:int,end:int>>"


def plain(word):
    return word.lower().strip(SIGNS)


def words_of(text):
    return [w for w in map(plain, (text or "").split()) if w]


def seeds(shared):
    """Places of an item's seeds, by how many items have the n-gram at each place."""
    rare = [place for place, count in enumerate(shared) if count <= SHARED_ITEMS]
    chosen = list(rare)
    for low, high in zip([-1, *rare], [*rare, len(shared)]):
        for start in range(low + 1, high - STRETCH + 1, STRETCH):
            chosen.append(min(range(start, start + STRETCH), key=shared.__getitem__))
    if shared and not chosen:
        chosen.append(min(range(len(shared)), key=shared.__getitem__))
    return sorted(chosen)


class Block:
    """Some benchmark items as word numbers, and the n-grams to look for."""

    def __init__(self, items):
        self.ids = [item_id for item_id, _ in items]
        texts = [words_of(text) for _, text in items]
        number = {}
        for words in texts:
            for word in words:
                number.setdefault(word, len(number) + 1)
        self.number = number
        self.base = len(number) + 1
        self.items = [np.array([number[w] for w in words], np.int64) for words in texts]
        codes = [self.codes(item) for item in self.items]
        # Repeated items count once.
        different = {tuple(some.tolist()): some for some in codes}.values()
        shared = Counter(code for some in different for code in np.unique(some).tolist())
        places = defaultdict(list)  # n-gram code -> (item, position)
        for i, some in enumerate(codes):
            some = some.tolist()
            for position in seeds([shared[code] for code in some]):
                places[some[position]].append((i, position))
        self.grams = np.array(sorted(places), np.int64)
        listed = [places[code] for code in self.grams.tolist()]
        # The places of n-gram g are those from first[g] to first[g + 1].
        self.first = np.cumsum([0, *map(len, listed)])
        flat = np.array([p for some in listed for p in some], np.int64).reshape(-1, 2)
        self.place_item, self.place_position = flat[:, 0], flat[:, 1]

    def codes(self, numbers):
        """One code per n-gram; n-grams with a word unknown to the block get -1."""
        if len(numbers) < GRAM:
            return np.empty(0, np.int64)
        code = np.zeros(len(numbers) - GRAM + 1, np.int64)
        known = np.ones(len(code), bool)
        for i in range(GRAM):
            part = numbers[i : i + len(code)]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code, -1)

    def candidates(self, at, grams):
        """Items of some n-grams found at places of a text, and where each would start."""
        count = self.first[grams + 1] - self.first[grams]
        before = np.cumsum(count) - count
        place = np.arange(count.sum()) + np.repeat(self.first[grams] - before, count)
        item = self.place_item[place]
        start = np.repeat(at, count) - self.place_position[place]
        order = np.lexsort((start, item))
        return item[order], start[order]


class Scanner:
    """Looks for a block's items in texts."""

    def __init__(self, block):
        self.block = block
        known = block.number
        self.word = Remembered(lambda w: known.get(plain(w), 0), "leaks")

    def hits(self, text):
        """Word numbers of a text, and the places and n-grams of its hits."""
        words = (text or "").split()
        numbers = np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))
        codes = self.block.codes(numbers)
        at = np.flatnonzero(codes >= 0)
        if not len(at) or not len(self.block.grams):
            return numbers, at[:0], at[:0]
        gram = np.searchsorted(self.block.grams, codes[at])
        gram[gram == len(self.block.grams)] = 0
        found = self.block.grams[gram] == codes[at]
        return numbers, at[found], gram[found]

    def leaks(self, text):
        """The best place of every item whose score reaches SCORE."""
        numbers, at, grams = self.hits(text)
        if not len(at):
            return []
        items, starts = self.block.candidates(at, grams)
        edges = np.flatnonzero(np.diff(items, prepend=-1, append=-1))
        found = []
        for low_edge, high_edge in zip(edges[:-1], edges[1:]):
            item = int(items[low_edge])
            wanted = self.block.items[item]
            best = max(
                self.aligned(wanted, numbers, low, high)
                for low, high in clusters(starts[low_edge:high_edge].tolist(), len(wanted))
            )
            if best[0] >= SCORE:
                found.append(
                    {
                        "item_id": self.block.ids[item],
                        "score": round(best[0], 6),
                        "start": best[1],
                        "end": best[2],
                    }
                )
        return found

    @staticmethod
    def aligned(wanted, numbers, low, high):
        slack = len(wanted) // 4 + 1
        low = max(0, low - slack)
        window = numbers[low : high + len(wanted) + slack]
        # Of the words an alignment spans, those of the item gain MATCH at most and the
        # others lose at least one MISMATCH or GAP, so the best run bounds the value.
        gain = np.where(np.isin(window, wanted), MATCH, max(MISMATCH, GAP))
        total = np.concatenate([[0], np.cumsum(gain)])
        if (total - np.minimum.accumulate(total)).max() < SCORE * MATCH * len(wanted):
            return 0.0, 0, 0
        value, start, end = smith_waterman(wanted, window)
        return value / (MATCH * len(wanted)), low + start, low + end


def clusters(starts, length):
    """Ranges of expected starts that lie close together."""
    low = high = starts[0]
    for start in starts[1:]:
        if start - high > length // 2:
            yield low, high
            low = start
        high = start
    yield low, high


def smith_waterman(wanted, window):
    """Best local alignment: its value, and start and end in the window.

    Row by row; within a row a gap's cost is linear, so the best gap is a running
    maximum. The start follows the cell each value came from.
    """
    width = len(window)
    at = np.arange(width)
    row, start = np.zeros(width, np.int64), at.copy()
    best = (0, 0, 0)
    for word in wanted:
        step = np.where(window == word, MATCH, MISMATCH)
        diagonal = step.copy()
        diagonal[1:] += row[:-1]
        begun = at.copy()
        begun[1:] = np.where(row[:-1] > 0, start[:-1], at[1:])
        down = row + GAP
        take = down > diagonal
        value = np.where(take, down, diagonal)
        begun = np.where(take, start, begun)
        # A gap along the row: the best value so far, less GAP per word passed.
        raised = value - GAP * at
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, at, 0))
        value, begun = top + GAP * at, begun[source]
        row = np.maximum(value, 0)
        start = np.where(row > 0, begun, at)
        end = int(row.argmax())
        if row[end] > best[0]:
            best = int(row[end]), int(start[end]), end + 1
    return best


def blocks(benchmark):
    """The benchmark as lists of (item_id, text) of a bounded number of words."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = -(-words // BLOCK_WORDS)
    for i in range(count):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield [(row.item_id, row.text) for row in mine.orderBy("item_id", "text").collect()]


def leak_column(shared):
    @pandas_udf(LEAKS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in parts:
            yield pd.Series([scanner.leaks(t) for t in texts], dtype=object)

    return run(F.col("text"))


def with_leaks(docs, benchmark):
    """``docs`` with ``leaks``: item_id, score and word range of every item found."""
    context = docs.sparkSession.sparkContext
    found = []
    for items in blocks(benchmark):
        block = Block(items)
        if not len(block.grams):
            continue
        found.append(leak_column(context.broadcast(block)))
    if not found:
        return docs.withColumn("leaks", F.expr(f"cast(array() as {LEAKS})"))
    return docs.withColumn("leaks", F.concat(*found) if len(found) > 1 else found[0])
