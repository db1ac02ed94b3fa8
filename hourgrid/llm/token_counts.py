"""Token counts by byte-pair merging with a heap over a linked list.

The count of a piece is its number of initial byte symbols minus the merges that
apply; no identifier is ever produced. It works on any
byte-level BPE file in the JSON layout of the ``tokenizers`` library.

Defined cases: null text counts as empty and has no token; a special string
inside a text is one token; repeated rows are counted one by one; columns other
than ``doc_id`` and ``text`` are ignored.
"""

import json
import re
import weakref
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import functions as F

from hourgrid.llm.common import Worker, held, map_rows, take_over

# Fixed value: the published splitting pattern of this family of tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 80_000
TOKEN_WORDS = 200_000  # where a new word costs most
CACHED_LENGTH = 64


def byte_symbols():
    """Printable stand-in of every byte: itself if printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {
        b: chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)
    }


class BytePairs:
    """Merge ranks over numbered symbols; bytes are symbols 0 to 255."""

    def __init__(self, merges, specials):
        number = {symbol: byte for byte, symbol in byte_symbols().items()}
        self.ranks = {}
        self.made = []  # the symbol that the merge of each rank makes
        for rank, (left, right) in enumerate(merges):
            self.made.append(number.setdefault(left + right, len(number)))
            self.ranks[number[left], number[right]] = rank
        self.pieces = regex.compile(PIECES)
        self.specials = (
            regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
            if specials
            else None
        )

    @classmethod
    def load(cls, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [
            tuple(m) if isinstance(m, list) else tuple(m.split(" "))
            for m in spec["model"]["merges"]
        ]
        return cls(merges, [t["content"] for t in spec.get("added_tokens", [])])

    def merged(self, piece):
        """Tokens of one piece (bytes): pop the lowest-ranked live pair, leftmost first.

        A heap entry is rank * size + position. It is stale, and skipped, if the
        symbols linked at that position no longer have that rank.
        """
        symbol = [*piece]
        size = len(symbol)
        if size == 1:
            return 1
        rank_of, made = self.ranks.get, self.made
        heap = [
            rank * size + i
            for i, rank in enumerate(map(rank_of, zip(symbol, symbol[1:])))
            if rank is not None
        ]
        heapify(heap)
        after = [*range(1, size), -1]
        before = [*range(-1, size - 1)]
        tokens = size
        while heap:
            rank, i = divmod(heappop(heap), size)
            j = after[i]
            if j < 0 or rank_of((symbol[i], symbol[j])) != rank:
                continue
            new = symbol[i] = made[rank]
            symbol[j] = -1
            tokens -= 1
            j = after[i] = after[j]
            if j >= 0:
                before[j] = i
                rank = rank_of((new, symbol[j]))
                if rank is not None:
                    heappush(heap, rank * size + i)
            j = before[i]
            if j >= 0:
                rank = rank_of((symbol[j], new))
                if rank is not None:
                    heappush(heap, rank * size + j)
        return tokens



class Remembered(dict):
    """A function's results, in two generations of a bounded number of short keys.

    What the stages of other owners remembered goes when the first new key comes.
    """

    def __init__(self, function, owner, bound=CACHED_WORDS, length=CACHED_LENGTH):
        super().__init__()
        self.function, self.owner, self.older = function, owner, {}
        self.bound, self.length = bound, length
        Worker.remembered.append(weakref.ref(self))

    def __missing__(self, key):
        if Worker.owner != self.owner:
            take_over(self.owner)
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.length:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self):
        self.clear()
        self.older = {}


DOUBLE_BLANK = re.compile(r"\s\s")


def words_stand_alone(text):
    """True if every blank of a (non-empty) text lies between two other characters.

    A single space between two other characters always starts a new piece, so
    such a text can be treated as its words, each with the space before it.
    """
    return not (text[0].isspace() or text[-1].isspace() or DOUBLE_BLANK.search(text))


class WordCounter:
    """Counts of texts from the remembered counts of their words."""

    def __init__(self, pairs):
        self.pairs = pairs
        self.piece = Remembered(lambda piece: pairs.merged(piece.encode("utf-8")), "counts", TOKEN_WORDS)
        self.word = Remembered(lambda word: self.plain(" " + word), "counts", TOKEN_WORDS)

    def plain(self, text):
        piece = self.piece
        return sum([piece[p] for p in self.pairs.pieces.findall(text)])

    def count(self, text):
        specials = self.pairs.specials
        if specials and specials.search(text):
            parts = specials.split(text)
            return sum(map(self.count, parts)) + len(parts) - 1
        if not text:
            return 0
        if not words_stand_alone(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + sum(map(self.word.__getitem__, rest))


def word_counter(path):
    return held("counts", path, lambda: WordCounter(BytePairs.load(path)))


def token_counts(docs, tokenizer):
    """One row per document: doc_id, n_bytes, n_tokens. ``tokenizer`` is a file path."""

    def rows(batch):
        count = word_counter(tokenizer).count
        texts = [t or "" for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": [count(t) for t in texts],
        }

    return map_rows(
        docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, n_tokens long"
    )


def over_limit(counts, limit):
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
