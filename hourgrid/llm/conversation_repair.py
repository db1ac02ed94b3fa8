"""Cheapest repair of conversations, proved optimal by branch and bound.

A repaired conversation is empty, or an optional system row followed by one or more
pairs of a user and an assistant row. Edits in order give it: Keep a row (0), Rerole it
to user or assistant (2), Delete it (3), Insert an empty user or assistant row (2); a
truncated row that is not deleted adds 1, and blank and duplicate rows must be deleted.
Of the cheapest lists of edits the one with the least initials in ASCII wins, which
decides the repaired rows wholly.

1. Rows get their faults in DataFrame expressions and are sorted within conversations;
   only roles, faults and digests move.
2. Per conversation a depth-first search runs over (rows done, last role). It has its
   own stack, a lower bound of what the rest of the rows costs from each state, an
   incumbent (cost, audit), first the cost of a greedy descent, and for each node a table
   of the best prefix that reached it; worse prefixes are dropped there. Edits are tried
   in the order of bound and initial. An empty stack is the proof.
3. Long conversations are searched in segments of SEGMENT rows: the node tables at the
   end of one are the starts of the next, so memory stays at one segment, the audit and
   a few bytes a row.
4. Edits are applied while the sorted texts stream by, with one row held at a time.

Rows of one conversation follow each other, so one task reads a conversation in order,
however long; it never holds its texts.

Defined cases: a null conv_id is a conversation of its own; null roles and texts are one
space; rows go by turn, null first, then by role and digest of the text, so repeated
rows lie side by side and all but one are duplicates; a role other than system, user and
assistant goes by its first letter, and none or another has to be reroled or deleted;
without rows the result is empty; other columns are ignored.
"""

import hashlib
import os.path
from array import array

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from hourgrid.llm.common import arrow_schema

SEGMENT = 512
OUT_ROWS = 256  # rows of repaired text in one batch
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The one role that may come next by edit, after each state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
CLEAN, CUT, GONE = range(3)
DEAREST = 1 << 60
LAST_AUDIT = "~"  # after every audit

STATISTICS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def least_costs(rows):
    """Lower bounds of the cost of every suffix of (role, fault) rows, by state.

    They leave the audit out of account, and are as sharp as that allows: weaker ones
    (costs row by row, or system rows kept anywhere) let the search grow exponentially
    on conversations of some hundred rows.
    """
    bound = [array("q", bytes(8 * (len(rows) + 1))) for _ in NEXT]
    for i in range(len(rows), -1, -1):
        least = [0 if i == len(rows) and state in FINAL else DEAREST for state in NEXT]
        for state in NEXT:
            for initial, price, j, after in edits(rows, i, state):
                if initial != "I":
                    least[state] = min(least[state], price + bound[after][j])
        for _ in range(2):  # two insertions lead to every state that one can reach
            for state, follow in NEXT.items():
                least[state] = min(least[state], INSERT + least[follow])
        for state in NEXT:
            bound[state][i] = least[state]
    return bound


def edits(rows, i, state):
    """(initial, cost, rows done, state) of every edit at a node."""
    follow = NEXT[state]
    yield "I", INSERT, i, follow
    if i < len(rows):
        role, fault = rows[i]
        yield "D", DELETE, i + 1, state
        if fault != GONE:
            extra = TRUNCATED if fault == CUT else 0
            yield "R", REROLE + extra, i + 1, follow
            if role == follow or (role == SYSTEM and state == START):
                yield "K", extra, i + 1, role


def descent(rows, bound):
    """The cost of the list of edits that looks cheapest at every step."""
    i, state, cost = 0, START, 0
    while i < len(rows) or state not in FINAL:
        _, price, i, state = min(
            edits(rows, i, state), key=lambda e: (e[1] + bound[e[3]][e[2]], -e[2], e[0])
        )
        cost += price
    return cost


def search(rows, start, end, starts, bound, limit):
    """The best (cost, audit) of every state after ``end`` rows, from those at ``start``.

    No complete list of edits costs more than ``limit``; prefixes that must, go.
    """
    tables = [{} for _ in range(start, end + 1)]
    tables[0] = dict(starts)
    stack = [(start, state, *best) for state, best in starts.items()]
    incumbent = (limit, LAST_AUDIT)
    while stack:
        i, state, cost, audit = stack.pop()
        if tables[i - start][state] != (cost, audit):
            continue  # a better prefix came here since
        least = cost + bound[state][i]
        if least == incumbent[0] and audit > incumbent[1][: len(audit)]:
            continue
        if i == len(rows) and state in FINAL:
            incumbent = min(incumbent, (cost, audit))
        found = []
        for initial, price, j, after in edits(rows, i, state):
            if j > end or cost + price + bound[after][j] > incumbent[0]:
                continue
            reached = (cost + price, audit + initial)
            held = tables[j - start].get(after)
            if held is None or reached < held:
                tables[j - start][after] = reached
                found.append((cost + price + bound[after][j], initial, j, after, reached))
        # The most promising edit is tried first.
        for _, _, j, after, reached in sorted(found, reverse=True):
            stack.append((j, after, *reached))
    return tables[-1]


def cheapest(rows):
    """Cost and audit of the best repair of (role, fault) rows."""
    bound = least_costs(rows)
    limit = descent(rows, bound)
    best, settled = {START: (0, "")}, []
    for start in range(0, max(len(rows), 1), SEGMENT):
        # What all prefixes share decides nothing any more.
        shared = os.path.commonprefix([audit for _, audit in best.values()])
        settled.append(shared)
        best = {s: (cost, audit[len(shared) :]) for s, (cost, audit) in best.items()}
        end = min(start + SEGMENT, len(rows))
        best = search(rows, start, end, best, bound, limit)
    cost, audit = min(best[state] for state in FINAL if state in best)
    return cost, "".join(settled) + audit


class Conversation:
    """Statistics and row codes of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.counts = dict.fromkeys(STATISTICS, 0)
        self.first = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn, initial, fault):
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.first = turn if self.turns == 0 else self.first
            self.turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        if fault is not None:
            self.counts[fault] += 1
        code = GONE if fault in ("blank", "duplicate") else CUT if fault else CLEAN
        self.codes.append(INITIALS.get(initial, 0) * 3 + code)

    def row(self):
        if self.turns:
            self.counts["gaps"] = self.turn - self.first + 1 - self.turns
        self.counts["cost"], audit = cheapest([divmod(code, 3) for code in self.codes])
        return {"conv_id": self.conv_id, **self.counts, "audit": audit}


def plain(rows):
    """The rows that the operator works on, with the digest that breaks ties."""
    role, text = (F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text"))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest")
    )


def ordered(rows, *between):
    """Rows of each conversation side by side and in order, within tasks."""
    turn = F.asc_nulls_first("turn")
    return rows.sortWithinPartitions(
        F.asc_nulls_first("conv_id"), *between, turn, "role", "digest"
    )


def faults(rows):
    """conv_id, turn, role, digest, initial and first fault of every row."""
    bare = F.btrim("text", F.lit(BLANKS))
    narrow = plain(rows).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        F.left("role", F.lit(1)).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    # Dealt by conversation, equal rows lie together as well.
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    narrow = narrow.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("again"), "duplicate")
        .when(F.col("truncated"), "truncated")
    )
    return narrow.withColumn("fault", fault)


def audits(rows):
    """gaps, faults, illegal neighbours, cost and audit of every conversation."""
    schema = StructType([rows.schema["conv_id"]])
    for name in STATISTICS:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string")
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches):
        now = None
        for batch in batches:
            finished = []
            for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        finished.append(now.row())
                    now = Conversation(conv_id)
                now.add(*row)
            yield pa.RecordBatch.from_pylist(finished, schema=target)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=target)

    columns = ("conv_id", "turn", "initial", "fault")
    return ordered(faults(rows)).select(*columns).mapInArrow(run, schema)


class Repair:
    """Applies an audit to the rows of a conversation in order."""

    def __init__(self, audit):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role, text):
        """The rows that come out up to and with the next row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = INITIALS[role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, ROLES[self.state], text


def applied(rows, repairs):
    """Each conversation's audit, followed by its rows in order, in one task."""
    texts = plain(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = repairs.select("conv_id", "audit")
    both = texts.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    both = ordered(both, F.col("audit").isNull())
    return both.select("conv_id", "audit", "role", "text")


def walked(batches):
    """(conv_id, None) as a conversation starts, then (conv_id, (edit, role, text))."""
    now, repair = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(start, OUT_ROWS)
            for conv_id, audit, role, text in zip(*(c.to_pylist() for c in part.columns)):
                if audit is not None:
                    if repair is not None:
                        yield from ((now, row) for row in repair.inserted())
                    now, repair = conv_id, Repair(audit)
                    yield now, None
                else:
                    yield from ((now, row) for row in repair.row(role, text))
    if repair is not None:
        yield from ((now, row) for row in repair.inserted())


def repaired_rows(rows, repairs):
    """The rows of the repaired conversations: conv_id, position, edit, role, text."""
    schema = StructType([rows.schema["conv_id"]]).add("position", "long")
    schema = schema.add("edit", StringType()).add("role", "string").add("text", "string")
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches):
        held, position = [], 0
        for conv_id, row in walked(batches):
            if row is None:
                position = 0
                continue
            held.append((conv_id, position, *row))
            position += 1
            if len(held) == OUT_ROWS:
                yield as_batch(held, target)
                held = []
        yield as_batch(held, target)

    return applied(rows, repairs).mapInArrow(run, schema)


def as_batch(rows, target):
    columns = zip(*rows) if rows else [() for _ in target]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target
    )


def digests(rows, repairs):
    """SHA-256 of the lines ``role:text`` of every repaired conversation."""
    schema = StructType([rows.schema["conv_id"]]).add("repaired_sha256", "string")
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches):
        held, sha, lines = [], None, 0
        for conv_id, row in walked(batches):
            if row is None:
                if sha is not None:
                    held.append((now, sha.hexdigest()))
                if len(held) >= OUT_ROWS:
                    yield as_batch(held, target)
                    held = []
                now, sha, lines = conv_id, hashlib.sha256(), 0
                continue
            _, role, text = row
            sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
        if sha is not None:
            held.append((now, sha.hexdigest()))
        yield as_batch(held, target)

    return applied(rows, repairs).mapInArrow(run, schema)


def damaged(rows):
    """Rows with faults drawn from crc32 of ``conv_id:turn``, for trials of the repair.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 takes its full stops,
    question and exclamation marks away, 3 repeats it, 4 gives it the role user.
    """
    conv_id, turn, role, text = (
        F.coalesce(F.col(name).cast("string"), F.lit(" "))
        for name in ("conv_id", "turn", "role", "text")
    )
    kind = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def repaired(scratch, rows):
    """One row per conversation: statistics, cost, audit and digest of its repair.

    The audits are staged in ``scratch``.
    """
    repairs = scratch.stage(audits(rows), "audits")
    hashes = digests(rows, repairs)
    return repairs.join(hashes, repairs.conv_id.eqNullSafe(hashes.conv_id)).drop(hashes.conv_id)


def trial(scratch, rows):
    """The repair of damaged rows, with a row for every conversation of ``rows``.

    A conversation that lost all rows has zeros, an empty audit and the digest of nothing.
    """
    ids = rows.select("conv_id").distinct()
    found = repaired(scratch, damaged(rows))
    same = ids.conv_id.eqNullSafe(found.conv_id)
    nothing = hashlib.sha256().hexdigest()
    return (
        ids.join(found, same, "left")
        .drop(found.conv_id)
        .na.fill(0, list(STATISTICS))
        .na.fill({"audit": "", "repaired_sha256": nothing})
    )
