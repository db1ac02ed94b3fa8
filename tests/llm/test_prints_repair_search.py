"""Fingerprints, conversation repair and lexical search against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.llm import conversation_repair as repair
from hourgrid.llm import fingerprints, lexical_search
from hourgrid.session import Scratch

SCHEMA = "doc_id long, text string, fingerprint string, score long, row string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "f", 1, "r") for row in rows], SCHEMA).repartition(5)


def texts():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "the rent óla nd ZU".split() for b in range(60)]
    base = [rng.choice(words) for _ in range(400)]
    near = [" ".join([*base[:i], "odd", *base[i + 1 :]]) for i in range(0, 400, 16)]
    return [
        None, "", " \n", "a", "A", "...", "日本語 テスト", "x" * 3000, *near, *near[:9],
        *(" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(60)),
        " ".join(rng.choices(words, k=4000)), "word " * 500 + "\x0b.,word",
    ]


@pytest.fixture(scope="module")
def rows():
    listed = [(i, t) for i, t in enumerate(texts())]
    return [*listed, (7, "x" * 3000), (None, "the0 rent1"), (None, "a b"), (3, "another")]


# ---- fingerprints


def test_terms_of_long_texts_do_not_depend_on_runs(monkeypatch):
    text = " a  " + "y" * 70 + " " + "\n".join(f"w{i}" for i in range(90)) + "\t" + "z" * 64 + "end "
    whole, _ = fingerprints.word_hashes([text.encode()])
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(whole)
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 80)
    cut = np.concatenate(list(fingerprints.word_runs(text.encode())))
    assert cut.tolist() == whole.tolist()
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 16)
    cut = np.concatenate(list(fingerprints.word_runs(text.encode()))).tolist()
    assert len(cut) == len(whole)
    assert [a == b for a, b in zip(cut, whole.tolist())] == [len(w) <= 16 for w in text.split()]


def test_fingerprints_vote_by_roots_of_counts():
    text = "b a b a b c"
    words = text.split()
    pairs = Counter(zip(["<"] + words, words + [">"]))
    hashes, _ = fingerprints.terms([text.encode()])
    order = list(zip(["<"] + words[:-1], words)) + [(words[-1], ">")]
    votes = np.zeros(fingerprints.BITS)
    for pair, value in {p: h for p, h in zip(order, hashes)}.items():
        for word in range(fingerprints.WORDS64):
            salted = (int(value) + (word + 1) * fingerprints.MIX[2]) % (1 << 64)
            bits = fingerprints.mixed(np.array([salted], np.uint64)).view(np.uint8)
            bits = np.unpackbits(bits)
            votes[word * 64 : word * 64 + 64] += np.sqrt(pairs[pair]) * (bits * 2.0 - 1)
    found = fingerprints.fingerprints_of([text, "", " ", "B a b A b C", text + " d"])
    assert found[0].tolist() == np.packbits(votes > 1e-9).tolist() == found[3].tolist()
    assert not found[1].any() and not found[2].any()
    assert found[0].tolist() != found[4].tolist()


@pytest.mark.parametrize("radius", [0, 7, 20])
def test_all_fingerprints_in_the_radius_are_found(spark, rows, radius, monkeypatch):
    monkeypatch.setattr(fingerprints, "LIST", 4)
    monkeypatch.setattr(fingerprints, "TILE", 3)
    prints = fingerprints.fingerprints_of([t or "" for _, t in rows])
    with Scratch(spark, "prints") as scratch:
        own = fingerprints.fingerprints(table(spark, rows))
        found = fingerprints.near_classes(scratch, own, radius).collect()
    of = {row.fingerprint: row for row in found}
    assert len(of) == len(found) == len({p.tobytes() for p in prints})
    linked = 0
    for one in prints:
        distance = np.bitwise_count(prints ^ one).sum(axis=1)
        row = of[one.tobytes()]
        assert row.n_near == (distance <= radius).sum() - 1
        mates = [i for (i, _), d in zip(rows, distance) if d == 0]
        assert row.class_size == len(mates)
        assert row.class_id == min((i for i in mates if i is not None), default=None)
        linked += row.n_near >= row.class_size
    assert linked > 5 or radius < 20
    with pytest.raises(ValueError):
        fingerprints.blocks(32)


def test_edited_texts_take_the_next_document(spark, rows):
    with Scratch(spark, "prints") as scratch:
        spread = fingerprints.trial(scratch, table(spark, rows)).toPandas()
        alone = fingerprints.trial(scratch, table(spark, [(4, "seven s")])).collect()
        empty = fingerprints.trial(scratch, table(spark, [])).collect()
    assert len(spread) == len(rows) and empty == []
    assert alone[0].near_next == 1 and alone[0].n_chars == 7
    assert alone[0].edited_sha256 == hashlib.sha256(b"sevense").digest()
    single = [(i, t or "") for i, t in rows if i is not None and Counter(r[0] for r in rows)[i] == 1]
    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: -r[0])
    by_id = {int(r.doc_id): r for r in spread.itertuples() if r.doc_id == r.doc_id}
    ids = [i for i, _ in order]
    for i, t in single:
        at = ids.index(i)
        if at + 1 == len(ids) or ids[at + 1] not in dict(single):
            continue
        following = order[at + 1][1]
        size = len(t) // 3
        changed = t[: len(t) - size] + following[:size]
        assert bytes(by_id[i].edited_sha256) == hashlib.sha256(changed.encode()).digest()
        own, new, after = fingerprints.fingerprints_of([t, changed, following])
        assert bytes(by_id[i].fingerprint) == own.tobytes()
        assert by_id[i].near_edited == fingerprints.likeness(own[None], new[None])[0]
        assert by_id[i].near_next == fingerprints.likeness(own[None], after[None])[0]


# ---- conversation repair

GRAMMAR = re.compile("(s?(ua)+)?")


def result(codes, audit):
    """Cost and roles of an audit, or None if it does not fit the rows."""
    cost, out, rows = 0, "", iter(codes)
    for letter in audit:
        following = "a" if out.endswith("u") else "u"
        if letter == "I":
            cost, out = cost + 2, out + following
            continue
        role, fault = next(rows, (None, None))
        if role is None or (letter in "KR" and fault == repair.GONE):
            return None
        cost += {"K": 0, "R": 2, "D": 3}[letter] + (fault == repair.CUT and letter != "D")
        out += {"K": "?sua"[role], "R": following, "D": ""}[letter]
    return (cost, audit) if next(rows, None) is None and GRAMMAR.fullmatch(out) else None


def test_no_list_of_edits_is_cheaper():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.randrange(4)
        codes = [(rng.randrange(4), rng.randrange(3)) for _ in range(size)]
        every = (
            result(codes, "".join(letters))
            for length in range(size + 4)
            for letters in itertools.product("DIKR", repeat=length)
        )
        assert repair.cheapest(codes) == min(r for r in every if r is not None)


def suffix_best(codes):
    @lru_cache(maxsize=None)
    def best(i, state):
        found = [(0, "")] if i == len(codes) and state in repair.FINAL else []
        plain = []
        for inserts in range(3):
            at = state
            for _ in range(inserts):
                at = repair.NEXT[at]
            plain.append((2 * inserts, "I" * inserts, at))
        for cost, letters, at in plain:
            if i == len(codes):
                if at in repair.FINAL:
                    found.append((cost, letters))
                continue
            role, fault = codes[i]
            steps = [(3, "D", at)]
            if fault != repair.GONE:
                extra = fault == repair.CUT
                steps.append((2 + extra, "R", repair.NEXT[at]))
                if role == repair.NEXT[at] or (role, at) == (repair.SYSTEM, repair.START):
                    steps.append((extra, "K", role))
            for price, letter, then in steps:
                rest, tail = best(i + 1, then)
                found.append((cost + price + rest, letters + letter + tail))
        return min(found)

    return best(0, repair.START)


@pytest.mark.parametrize("segment", [1, 5, 512])
def test_segments_change_nothing(segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(8)
    for _ in range(60):
        roles = rng.choice(([0, 1, 2, 3], [2, 3], [2, 2, 3], [1, 2, 3]))
        codes = [(rng.choice(roles), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(60))]
        assert repair.cheapest(codes) == suffix_best(codes)
        bound, cost = repair.least_costs(codes), repair.cheapest(codes)[0]
        assert bound[repair.START][0] <= cost <= repair.descent(codes, bound)


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, kind string"


def test_conversations_are_repaired(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"),
        (1, 4, "assistant", "So"), (1, 5, "assistant", " \t"), (1, None, "user", "First."),
        (2, 3, "tool", "Out."), (2, 9, None, "x."), (3, 1, "user", None), (3, 1, "user", " "),
        (None, 2, "user", "Hm."), (None, 4, "assistant", "y" * 100_000),
    ]
    frame = spark.createDataFrame([(*r, "a", "k") for r in rows], CONVERSATIONS).repartition(4)
    with Scratch(spark, "repair") as scratch:
        audits = scratch.stage(repair.audits(frame))
        found = {r.conv_id: r for r in audits.collect()}
        out = repair.repaired_rows(frame, audits).orderBy("conv_id", "position").collect()
        shas = {r.conv_id: r.repaired_sha256 for r in repair.repaired(scratch, frame).collect()}
        nothing = repair.repaired(scratch, frame.limit(0)).collect()
    assert nothing == []
    one = found[1]
    # First. (user), Be brief. (system), Why?, Why?, So, blank
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (2, 1, 1, 1, 3)
    # user, assistant (was system), assistant (cut) goes, the rest too
    assert (one.cost, one.audit) == repair.cheapest([(2, 0), (1, 0), (2, 0), (2, 2), (3, 1), (3, 2)])
    assert (found[2].gaps, found[2].cost, found[2].audit) == (5, 4, "RR")
    assert (found[3].blank, found[3].cost, found[3].audit) == (2, 6, "DD")
    assert (found[None].cost, found[None].audit, found[None].truncated) == (1, "KK", 1)
    for conv_id in (1, 2, None):
        lines = [f"{r.role}:{r.text}" for r in out if r.conv_id == conv_id]
        assert shas[conv_id] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
    assert shas[3] == hashlib.sha256(b"").hexdigest()
    assert [(r.edit, r.role) for r in out if r.conv_id == 2] == [("R", "user"), ("R", "assistant")]


def test_audit_of_a_long_conversation(spark):
    rows = [(5, i, "user" if i % 3 else "assistant", f"Row {i}{'.' * (i % 4 > 0)}", "", "") for i in range(3000)]
    frame = spark.createDataFrame(rows, CONVERSATIONS).repartition(6)
    codes = [(2 if i % 3 else 3, 0 if i % 4 else 1) for i in range(3000)]
    row = repair.audits(frame).first()
    assert (row.cost, row.audit) == repair.cheapest(codes)
    assert row.truncated == 750 and row.gaps == 0


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def ranked_by_hand(rows, items, k):
    counted = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(term for _, c, _ in counted for term in c)
    out = []
    for item_id, text in items:
        wanted = Counter(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, r in wanted.items() if t in c
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket, block", [(4096, 1 << 20), (8, 400)])
def test_ranking_equals_every_score(spark, rows, bucket, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    bodies = [t for _, t in rows if t]
    rng = random.Random(6)
    items = [(i, " ".join(rng.sample(rng.choice(bodies).split() or ["q"], 1) * 2 + rng.choice(bodies).split()[:30])) for i in range(40)]
    items += [(50, None), (51, ""), (52, "..."), (53, "absent-word"), (54, "THE0 the0 óla1 ÓLA1"), (55, items[0][1])]
    frame = spark.createDataFrame([*items, items[0]], "item_id long, text string").repartition(3)
    with Scratch(spark, "search") as scratch:
        found = lexical_search.ranked(scratch, table(spark, rows), frame, 7)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        found = sorted(map(tuple, found.collect()), key=repr)
    assert found == ranked_by_hand(rows, items, 7)


def test_ranking_without_documents_or_items(spark, rows):
    docs = table(spark, rows)
    items = spark.createDataFrame([(1, "the0 rent1"), (2, None)], "item_id long, text string")
    with Scratch(spark, "search") as scratch:
        assert lexical_search.ranked(scratch, docs.limit(0), items, 3).collect() == []
        assert lexical_search.ranked(scratch, docs, items.limit(0), 3).collect() == []
        assert lexical_search.ranked(scratch, docs, items.where("item_id = 2"), 3).collect() == []


def test_bounds_leave_out_no_document():
    """Every row whose exact score reaches a threshold survives it."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(300)]
    values = [rng.integers(1, 900_000, len(ids)) for ids in lists]
    length = [float(np.sqrt((v.astype(float) ** 2).sum())) for v in values]
    order = np.argsort(length)[::-1]
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([int(i) for i in order]),
            "ids": pa.array([lists[i].tolist() for i in order], pa.list_(pa.int32())),
            "impacts": pa.array([values[i].tolist() for i in order], pa.list_(pa.int32())),
            "length": pa.array([length[i] for i in order]),
        }
    )
    bucket = lexical_search.Bucket(batch)
    fewer = 0
    for _ in range(20):
        terms = np.sort(rng.choice(40, 6, replace=False))
        query = lexical_search.Query(terms, rng.integers(1, 9000, 6), 40)
        scores = bucket.scores(query, np.arange(300))
        for row in range(0, 300, 50):
            few = bucket.scores(query, np.arange(row, row + 10))
            assert few.tolist() == scores[row : row + 10].tolist()
        for threshold in np.sort(scores)[[-1, -5, -40]]:
            if threshold:
                kept = bucket.survivors(query, float(threshold))
                assert set(np.nonzero(scores >= threshold)[0]) <= set(kept)
                fewer += len(kept) < (scores > 0).sum()
    assert fewer > 20
