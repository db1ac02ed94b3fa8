"""Toxicity scores: boosted trees over a few dense features, calibrated by isotonic regression.

Learning takes a bounded sample of labelled documents (SAMPLE rows by a hash of
doc_id; held-out documents never enter it), in three parts that share no document:

* one gives the lexicon: words and word beginnings that occur in toxic documents in
  many different contexts and hardly ever elsewhere. Contexts are counted in a
  64-bit set, so copies of one text count once, and counts merge before a shuffle;
* one trains gradient-boosted trees on the features of its documents;
* one fits the isotonic curve that turns the trees' output into a probability.

Features are lexicon densities by strength, closeness to second-person words, capitals,
punctuation and obfuscation rates. They come from whole texts, word by word.

Defined cases: null and empty texts have features of zero and get a score like any
other; labels other than 0 and 1 are ignored, and of several labels of a document the
largest counts; without labels of both classes every score is the share of label 1 (0
if there are none); a null doc_id is not held out; other columns are kept; repeated
rows get the same score.
"""

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from hourgrid.llm.common import held, map_rows
from hourgrid.llm.token_counts import Remembered

SAMPLE = 20_000
LEXICON = 2_000
CONTEXTS = 4
WEIGHT = 2.5  # natural logarithm of how much likelier an entry is in toxic documents
STRONG = 5.0
STEMS = range(4, 9)
TREES, DEPTH, STEP = 20, 4, 0.2
NEAR = 6

# Second-person words of the languages at hand, and look-alike signs.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer "
    "sie tu te toi ton ta tes vous votre vos usted ustedes ti contigo vosotros os".split()
)
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")
REPEATED = re.compile(r"(.)\1\1")
INNER = re.compile(r"[^\W\d_][^\w\s'’\-.,][^\W\d_]|[^\W\d_]\d+[^\W\d_]")
LETTERS = re.compile(r"[\W\d_]+")
# Fields of a word's packed number: bits to shift, largest value.
FIELDS = {
    "weight": (0, 255),
    "upper": (8, 255),
    "marks": (16, 255),
    "shouts": (24, 255),
    "length": (32, 65535),
    "hidden": (48, 1),
    "second": (49, 1),
    "capitals": (50, 1),
    "repeated": (51, 1),
}


def plain(word):
    """A word as letters only: lower case, look-alike signs read as the letters they mimic."""
    lower = word.lower()
    if lower.isascii() and lower.isalpha():
        return lower
    if any(map(str.isalpha, lower)):
        lower = lower.strip("!|.,;:?\"'()[]").translate(LOOK_ALIKE)
    return unicodedata.normalize("NFC", LETTERS.sub("", lower))


def stems(word):
    """Keys of a plain word: its beginnings, and the whole of it with an end sign."""
    return [word[:n] for n in STEMS if n <= len(word)] + [word + "$"]


def packed_word(word, lexicon):
    bare = plain(word)
    weight = max([lexicon.get(s, 0.0) for s in stems(bare)])
    packed = packed_field("weight", round(16 * weight)) + packed_field("length", len(word))
    if bare in SECOND_PERSON:
        packed += packed_field("second", 1)
    if REPEATED.search(word):
        packed += packed_field("repeated", 1)
    # Most words are lower-case letters, which have none of what follows.
    if not word.islower():
        packed += packed_field("upper", sum(map(str.isupper, word)))
        packed += packed_field("capitals", int(len(bare) > 1 and word.isupper()))
    if not word.isalnum():
        packed += packed_field("marks", len(word) - sum(map(str.isalnum, word)))
        packed += packed_field("shouts", word.count("!"))
    if not word.isalpha():
        packed += packed_field("hidden", int(bool(INNER.search(word))))
    return packed


def packed_field(name, value):
    shift, top = FIELDS[name]
    return min(value, top) << shift


class Features:
    """Feature vectors of texts under one lexicon."""

    NAMES = (
        "strong", "weak", "strong_rate", "weak_rate", "weight_rate", "weight_most",
        "near_second", "distance", "second_rate", "hidden_rate", "hidden_hits",
        "upper_rate", "capitals_rate", "marks_rate", "shouts_rate", "repeated_rate", "words",
    )

    def __init__(self, lexicon):
        self.word = Remembered(lambda w: packed_word(w, lexicon), "toxicity")

    def of(self, text):
        words = (text or "").split()
        n = len(words)
        if not n:
            return [0.0] * len(self.NAMES)
        numbers = np.fromiter(map(self.word.__getitem__, words), np.int64, n)
        part = {k: (numbers >> shift) & top for k, (shift, top) in FIELDS.items()}
        weight = part["weight"] / 16.0
        strong = np.flatnonzero(weight >= STRONG)
        hits = np.flatnonzero(weight > 0)
        weak = len(hits) - len(strong)
        second = np.flatnonzero(part["second"])
        near, distance = 0, 99.0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            left = hits - second[np.maximum(at - 1, 0)]
            right = second[np.minimum(at, len(second) - 1)] - hits
            gaps = np.minimum(np.where(left > 0, left, 1 << 30), np.where(right > 0, right, 1 << 30))
            near, distance = int((gaps <= NEAR).sum()), float(min(gaps.min(), 99))
        letters = max(1, int(part["length"].sum()))
        return [
            float(len(strong)),
            float(weak),
            len(strong) / n,
            weak / n,
            float(weight.sum()) / n,
            float(weight.max()),
            float(near),
            distance,
            len(second) / n,
            float(part["hidden"].mean()),
            float((part["hidden"][hits]).sum()),
            float(part["upper"].sum()) / letters,
            float(part["capitals"].mean()),
            float(part["marks"].sum()) / letters,
            float(part["shouts"].sum()) / letters,
            float(part["repeated"].mean()),
            float(np.log1p(n)),
        ]


def features_of(lexicon):
    return held("toxicity", lexicon, lambda: Features(dict(lexicon)))


def feature_column(text, lexicon):
    """The feature vector of a text column; ``lexicon`` is a tuple of (stem, weight)."""

    @pandas_udf(ArrayType(DoubleType()))
    def run(texts):
        of = features_of(lexicon).of
        return pd.Series([of(t) for t in texts], dtype=object)

    return array_to_vector(run(text))


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def training_sample(scratch, docs, labels):
    """Text, label and part (0 to 9) of at most SAMPLE labelled documents."""
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )  # SAMPLE pairs of numbers: a bounded side
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("text", "toxic")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)).alias("part")
    return scratch.stage(rows.select("text", "toxic", part), "training")


def word_contexts(rows):
    """For every plain word and label: occurrences and the set of words before it."""

    def count(batch):
        sets, times = {}, {}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            before = ""
            for word in map(_plain.__getitem__, (text or "").split()):
                key = word, toxic
                sets[key] = sets.get(key, 0) | 1 << (_bucket[before])
                times[key] = times.get(key, 0) + 1
                before = word
        keys = [k for k in sets if k[0]]
        return {
            "word": [k[0] for k in keys],
            "toxic": [k[1] for k in keys],
            "contexts": [sets[k] - (1 << 64 if sets[k] >> 63 else 0) for k in keys],
            "times": [times[k] for k in keys],
        }

    return map_rows(rows, count, "word string, toxic int, contexts long, times long")


_plain = Remembered(plain, "toxicity")
_bucket = Remembered(lambda word: hash_bits(word), "toxicity")


def hash_bits(word):
    """A fixed number from 0 to 63 for a word."""
    return int.from_bytes(word.encode("utf-8", "replace"), "little") % 1_000_003 % 64


def learn_lexicon(rows):
    """Tuple of (stem, weight): at most LEXICON entries, from a bounded sample."""
    words = word_contexts(rows)
    merged = words.groupBy("word", "toxic").agg(
        F.bit_or("contexts").alias("contexts"), F.sum("times").alias("times")
    )
    length = F.length("word")
    keys = F.concat(
        F.transform(
            F.filter(F.array(*map(F.lit, STEMS)), lambda n: n <= length),
            lambda n: F.substring(F.col("word"), F.lit(1), n),
        ),
        F.array(F.concat("word", F.lit("$"))),
    )
    is_toxic = F.col("toxic") == 1
    counted = (
        merged.withColumn("stem", F.explode(keys))
        .groupBy("stem")
        .agg(
            F.bit_count(F.bit_or(F.when(is_toxic, F.col("contexts")))).alias("contexts"),
            F.coalesce(F.sum(F.when(is_toxic, F.col("times"))), F.lit(0)).alias("toxic"),
            F.coalesce(F.sum(F.when(~is_toxic, F.col("times"))), F.lit(0)).alias("clean"),
        )
    )
    totals = merged.agg(
        F.sum(F.when(is_toxic, F.col("times"))), F.sum(F.when(~is_toxic, F.col("times")))
    ).first()
    if not totals[0] or not totals[1]:
        return ()
    odds = F.log(
        ((F.col("toxic") + 0.1) / totals[0]) / ((F.col("clean") + 0.1) / totals[1])
    )
    entries = (
        counted.where(F.col("contexts") >= CONTEXTS)
        .withColumn("weight", odds)
        .where(F.col("weight") >= WEIGHT)
        .orderBy((F.col("weight") * F.col("toxic")).desc(), "stem")
        .limit(LEXICON)
        .collect()
    )
    return tuple((row.stem, round(row.weight, 3)) for row in entries)


class ToxicityModel:
    """A learned lexicon, trees and curve; or a constant where nothing could be learned."""

    def __init__(self, constant, lexicon=(), trees=None, curve=None):
        self.constant, self.lexicon, self.trees, self.curve = constant, lexicon, trees, curve

    def score(self, docs):
        """``docs`` with a column ``toxicity``, 0 to 1."""
        if self.trees is None:
            return docs.withColumn("toxicity", F.lit(float(self.constant)))
        made = docs.withColumn("__features", feature_column(F.col("text"), self.lexicon))
        made = self.trees.transform(made).withColumn(
            "__raw", vector_to_array("__probability")[1]
        )
        if self.curve is None:
            score = F.col("__raw")
        else:
            made = self.curve.transform(made)
            score = F.col("__curve")
        score = F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
        return made.withColumn("toxicity", score).drop(
            "__features", "__rawPrediction", "__probability", "__prediction", "__raw", "__curve"
        )


def learn(scratch, docs, labels):
    """A model from the labelled documents that are not held out."""
    rows = training_sample(scratch, docs, labels)
    shares = {(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    constant = shares.get(1, 0) / total if total else 0.0
    if min(shares.get(0, 0), shares.get(1, 0)) < 10:
        return ToxicityModel(constant)
    lexicon = learn_lexicon(rows.where("part < 5"))
    labelled = scratch.stage(
        rows.where("part >= 5").select(
            "part",
            F.col("toxic").cast("double").alias("label"),
            feature_column(F.col("text"), lexicon).alias("__features"),
        ),
        "features",
    )
    fit, curve_rows = labelled.where("part < 8"), labelled.where("part >= 8")
    if fit.select("label").distinct().count() < 2:
        return ToxicityModel(constant)
    trees = GBTClassifier(
        featuresCol="__features",
        predictionCol="__prediction",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=STEP,
        seed=7,
    ).fit(fit)
    trees.setRawPredictionCol("__rawPrediction").setProbabilityCol("__probability")
    raw = trees.transform(curve_rows).withColumn("__raw", vector_to_array("__probability")[1])
    curve = None
    if raw.select("label").distinct().count() == 2:
        curve = IsotonicRegression(
            featuresCol="__raw", labelCol="label", predictionCol="__curve"
        ).fit(raw.select("__raw", "label"))
    return ToxicityModel(constant, lexicon, trees, curve)
