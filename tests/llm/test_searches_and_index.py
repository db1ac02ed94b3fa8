"""Leaks against all pairs, the line index across processes, mentions of names, queries by SQL."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from hourgrid.llm import decontaminate, line_dedup, pii
from hourgrid.llm.queries import ORACLE, QUERIES
from hourgrid.session import Scratch
from hourgrid.sources import paths


@pytest.fixture(scope="module")
def scratch(spark):
    with Scratch(spark, "tests") as folder:
        yield folder


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


# ------------------------------------------------------------------ decontamination


def best_alignment(item, words):
    """The full table, cell by cell."""
    above, best = [0] * (len(words) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(words, 1):
            value = max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, row[-1] - 1)
            row.append(value)
            best = max(best, value)
        above = row
    return best


def grams(words):
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def test_leaks_equal_those_of_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(rng.randrange(8, 25))] for _ in range(12)]
    items.append(items[0][:])  # a repeated item reports too
    texts = []
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(0, 40))]
        for item in rng.sample(items, rng.randrange(0, 3)):
            share = rng.choice([0.0, 0.05, 0.15, 0.3, 0.5])
            edited = [w if rng.random() > share else word() for w in item if rng.random() > share / 3]
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited
        texts.append(words)
    expected = set()
    for doc_id, words in enumerate(texts):
        for item_id, item in enumerate(items):
            score = best_alignment(item, words) / (2 * len(item))
            if score >= decontaminate.SCORE and grams(item) & grams(words):
                expected.add((doc_id, item_id, round(score, 6)))
    docs = frame(spark, [" ".join(words) for words in texts])
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.with_leaks(docs.union(docs.limit(5)), benchmark)
    leaks = found.select("doc_id", F.explode("leaks").alias("l")).collect()
    assert {(r.doc_id, r.l.item_id, r.l.score) for r in leaks} == expected and len(expected) > 20


def test_a_phrase_that_items_share_is_no_seed():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50000)}"
    bodies = [[word() for _ in range(26)] for _ in range(4000)]
    phrase = "which of the following".split()
    plain = decontaminate.Scanner(decontaminate.Block([(i, " ".join(b)) for i, b in enumerate(bodies)]))
    shared = decontaminate.Scanner(
        decontaminate.Block([(i, " ".join(phrase + b)) for i, b in enumerate(bodies)])
    )
    text = " ".join(" ".join([*phrase, *(word() for _ in range(6))]) for _ in range(105))
    text += " " + " ".join(phrase + bodies[7][:12] + ["other"] + bodies[7][13:])
    seconds = []
    for scanner in (plain, shared):
        scanner.leaks(text)
        start = time.perf_counter()
        found = scanner.leaks(text)
        seconds.append(time.perf_counter() - start)
        assert [leak["item_id"] for leak in found] == [7]
    assert seconds[1] < 10 * seconds[0] + 0.005


def test_every_stretch_of_an_item_has_a_seed():
    few, many = decontaminate.SHARED_ITEMS, decontaminate.SHARED_ITEMS + 5
    assert decontaminate.seeds([]) == []
    assert decontaminate.seeds([many, many + 1]) == [0]
    assert decontaminate.seeds([few] * 5) == [0, 1, 2, 3, 4]
    assert decontaminate.seeds([many, many, few, many, many]) == [2]
    assert decontaminate.seeds([many + 1, many + 1, many, many + 1] * 2 + [few]) == [2, 6, 8]
    rng = random.Random(1)
    for _ in range(200):
        chosen = decontaminate.seeds([rng.choice([few, many, many + 9]) for _ in range(30)])
        edges = [-1, *chosen, 30]
        assert max(b - a for a, b in zip(edges, edges[1:])) <= 2 * decontaminate.STRETCH


# ------------------------------------------------------------------------ line index


def test_index_goes_on_after_its_process(spark, scratch):
    folder = scratch.folder("index")
    open_ = lambda **more: line_dedup.LineIndex(spark, folder, 2, shards=4, **more)
    first, second = frame(spark, ["a\nb", "A \nc"]), frame(spark, ["b\nd", "d", "e"])

    def dropped(index, docs):
        rows = index.drop_lines(docs).orderBy("doc_id").collect()
        return [r.text for r in rows], sorted((r.high, r.n) for r in index.counts().collect())

    index = open_()
    index.insert(first)
    assert dropped(open_(), first) == dropped(index, first)
    assert dropped(open_(), first)[0] == ["b", "c"]
    # A change that died before its commit leaves files that count for nothing.
    index.keys(second).write.parquet(f"{folder}/change-2")
    spark.range(1).write.parquet(f"{folder}/filters-2")
    spark.range(1).write.parquet(f"{folder}/commits/00000002/_temporary/0")
    again = open_()
    assert dropped(again, first)[0] == ["b", "c"]
    again.insert(second)
    assert dropped(open_(), second)[0] == ["", "", "e"]
    open_().delete(first)
    assert dropped(open_(), second)[0] == ["b", "", "e"]
    with pytest.raises(ValueError, match="other parameters"):
        open_(min_length=3)


def test_ledger_is_added_up(spark, scratch, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMPACT", 3)
    folder = scratch.folder("index")
    docs = frame(spark, ["a\nb", "a"])
    for turn in range(5):
        index = line_dedup.LineIndex(spark, folder, 2, shards=2)
        index.insert(docs) if turn % 2 == 0 else index.delete(docs)
        assert len(index.changes) < 3
    names = paths.list_folders(spark, folder)
    assert len([n for n in names if n.startswith("change-")]) <= 5
    assert len([n for n in names if n.startswith("filters-")]) <= 2
    found = line_dedup.LineIndex(spark, folder, 2, shards=2)
    assert sorted(r.n for r in found.counts().collect()) == [1, 2]
    assert [r.text for r in found.drop_lines(docs).orderBy("doc_id").collect()] == ["b", ""]
    found.delete(docs)
    assert found.counts().isEmpty()
    empty = line_dedup.LineIndex(spark, scratch.folder("empty"), 2, shards=2)
    empty.insert(docs.where("false"))
    assert empty.counts().isEmpty() and empty.drop_lines(docs.where("false")).isEmpty()


# ------------------------------------------------------------------------------ names


def test_names_are_replaced_wherever_they_stand(spark, scratch):
    rows = [
        "Mr. Peter Falk came. Falk said. Peter Falk left. Dr. Anna Weber and John Smith",
        "Prof. Dr. Weber asked; WEBER's answer to Weberian questions, falk and a falcon.",
        "Mr. Peter came alone. Anna Maria Weber wrote to anna.weber@corp.org.",
        "No one here. John went home; Falk stays a word without a name beside it.",
        "", None,
    ]
    docs = frame(spark, rows).selectExpr("*", "'kept' AS form", "7 AS kind")
    kept = scratch.stage(pii.settled(scratch, docs.union(docs), b"k"))
    out = [r.text for r in pii.rewritten(docs, b"k", kept).orderBy("doc_id").collect()]
    new = {(r.kind, r.form): r.surrogate.capitalize() for r in kept.collect()}
    falk, weber = new["family", "falk"], new["family", "weber"]
    peter, anna = new["given-m", "peter"], new["given-f", "anna"]
    john, smith = new["given-m", "john"], new["family", "smith"]
    assert out[0] == (
        f"Mr. {peter} {falk} came. {falk} said. {peter} {falk} left. "
        f"Dr. {anna} {weber} and {john} {smith}"
    )
    assert out[1] == (
        f"Prof. Dr. {weber} asked; {weber.upper()}'s answer to Weberian questions, falk and a falcon."
    )
    maria = new["given-f", "maria"]
    assert out[2].startswith(f"Mr. {peter} came alone. {anna} {maria} {weber} wrote to ")
    assert out[3:] == rows[3:] and len({*new.values()}) == len(new)
    assert anna in pii.GIVEN["latin", "f"] or anna[:2].isalpha()
    mx = pii.replaced("Mx. Robin Hale met Robin.", b"k", {})
    assert mx[1] == 3 and "Robin" not in mx[0] and "Hale" not in mx[0]
    empty = docs.where("false")
    assert pii.settled(scratch, empty, b"k").isEmpty()
    assert pii.rewritten(empty, b"k", kept).columns == [*empty.columns, "n_entities"]


# ---------------------------------------------------------------- registered queries

AWKWARD = [
    None, "", "\n", "a\nA \nb", "x " * 40_000, "Same text", "sAME tEXT", "Same text", "Ünï\nünÏ",
    "Licensed under the MIT License.", "ties\nb\n" * 3, "\t\nb\x0b\n",
]


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_line_dedup", "op8_exact_dedup"])
def test_registered_queries_equal_their_sql(spark, tmp_path, name):
    many = [(i, t) for i, t in enumerate(AWKWARD * 3)]
    docs = spark.createDataFrame(many + many[5:7], "doc_id long, text string")
    for clash in ("digest", "keep_id", "n_lines", "low", "shard"):
        docs = docs.withColumn(clash, F.lit("clash"))
    for label, rows in (("full", docs), ("none", docs.where("false"))):
        folder = str(tmp_path / label)
        rows.write.parquet(f"{folder}/documents.parquet")
        result = QUERIES[name](spark, folder)
        connection = duckdb.connect()
        connection.execute(
            f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')"
        )
        cursor = connection.execute(ORACLE[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(result.columns)
        got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
        assert got == sorted(map(tuple, cursor.fetchall()), key=repr), label
