"""Conversation structure repair by iterative-deepening A* (operator 11).

A conversation is repaired by the cheapest edits that make the initials of its
roles read ``(s?(ua)+)?``: keep a row (0), give it the role user or assistant
(2), delete it (3; a must for blank rows and for rows whose role and text stood
earlier), insert an empty user or assistant row anywhere (2); a truncated row
that is not deleted adds 1.  Of equally cheap repairs the one whose edits
(D, I, K, R) come first in ASCII order counts.

The search walks depth first in ASCII order of the edits under a cost bound,
raised to the least cost that exceeded it until a path is accepted; the first
one is the answer.  A failed state (row, last role) with the budget it failed
on is kept and never entered again on as little.  The estimate is that of the
same conversation without an optional system opening, which may save 3 at most.

All rows are numbered and cut into segments of at most ``SEGMENT``, so a
conversation that holds a large share of them is many rows of work: a row
becomes one character, and the characters of a segment are gathered.  Where a
conversation has several segments, a 4 x 4 table holds a segment's cost from
each last role to each; from the last segment backwards these give the exact
cost of what follows; every segment is searched by itself from each last role,
with that cost as its goal, and the repair is put together from the front.  (A
segment ends in the edit of its last row, so no candidate is the start of
another and the choice between ties falls within the segment.)  Texts are
shuffled once, for the hash of the repaired conversation, which takes them row
by row from a sorted stream.

Edge cases: null roles and texts are one blank; null ids are a conversation of
their own; null turns come first; rows of one turn stand by role, then by the
hash of role and text;
rows alike in all columns are duplicates of the first; conversations left
without rows give zeros, no edits and the hash of the empty text; an empty role
or another one than s..., u..., a... is never kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nnprobe.llm.common import map_rows, running_totals, store

SEGMENT = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = STATES = range(4)      # the last role of what is kept
NEVER = 1 << 60
# a row as one character: fault (none, truncated, must go) x initial (s, u, a, other)
INITIALS, FAULTS = "sua-", 3
EDITS = str.maketrans("uaUA", "IIRR")                   # steps to the edits' initials


def _moves(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(step, cost, rows consumed, next state) in ASCII order of the edits
    D, I, K, R.  Steps name inserted roles u, a and new roles U, A."""
    fault, initial = divmod(code, len(INITIALS))
    asked, follows = ("a", ASSISTANT) if state == USER else ("u", USER)
    out = [("D", DELETE, 1, state), (asked, INSERT, 0, follows)]
    if fault < 2:
        if INITIALS[initial] == asked:
            out.append(("K", KEEP + fault * TRUNCATED, 1, follows))
        elif INITIALS[initial] == "s" and state == START:
            out.append(("K", KEEP + fault * TRUNCATED, 1, SYSTEM))
        out.append((asked.upper(), REROLE + fault * TRUNCATED, 1, follows))
    return out


MOVES = [[_moves(code, state) for state in STATES] for code in range(FAULTS * len(INITIALS))]
TAIL = [[m for m in _moves(0, state) if not m[2]] for state in STATES]       # behind the last row: insert
ACCEPTED = [0, 2 * INSERT, INSERT, 0]                   # what the end of a conversation costs


def codes_of(text: str) -> list[int]:
    return [ord(c) - 65 for c in text]


def _chain(codes, goal):
    """Costs to go before every row (and at the end) by last role: USER and
    ASSISTANT hold exactly, the others only bound them from below."""
    u, a = goal[USER], goal[ASSISTANT]
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    out = [(u, a)]
    for code in reversed(codes):
        best = []
        for state in (USER, ASSISTANT):
            best.append(min(cost + (u if nxt == USER else a) for _, cost, used, nxt in MOVES[code][state] if used))
        u, a = min(best[0], best[1] + INSERT), min(best[1], best[0] + INSERT)
        out.append((u, a))
    return out[::-1]


def search(codes: list[int], entry: int, goal: list[int], last: bool) -> tuple[str, int, int]:
    """Steps, last role and cost of the cheapest repair of a segment that is
    entered with the role ``entry`` and whose end costs ``goal[role]``."""
    rows, chain = len(codes), _chain(codes, goal)
    opening = [min(goal[START] - goal[ASSISTANT], 0)] * (rows + 1)       # what a system opening may still save
    for i in range(rows - 1, -1, -1):
        fault, initial = divmod(codes[i], len(INITIALS))
        opening[i] = -DELETE if fault < 2 and INITIALS[initial] == "s" else opening[i + 1]

    def least(i, state):
        if i == rows and not last:
            return goal[state]
        u, a = chain[i]
        if state == USER:
            return u
        return max(a + opening[i], 0) if state == START else a

    bound, failed = least(0, entry), {}
    while True:
        beyond, steps = NEVER, []
        trail = [(0, entry, 0, iter(MOVES[codes[0]][entry]))]
        while trail:
            i, state, spent, todo = trail[-1]
            for step, cost, used, nxt in todo:
                j, cost = i + used, spent + cost
                need = cost + least(j, nxt)
                if need > bound:
                    beyond = min(beyond, need)
                    continue
                known = failed.get((j, nxt), -1)
                if known >= bound - cost:
                    beyond = min(beyond, cost + known + 1)
                    continue
                steps.append(step)
                if j == rows and (not last or nxt in (START, ASSISTANT)):
                    return "".join(steps), nxt, cost
                trail.append((j, nxt, cost, iter(MOVES[codes[j]][nxt] if j < rows else TAIL[nxt])))
                break
            else:
                failed[i, state] = bound - spent
                trail.pop()
                if steps:
                    steps.pop()
        bound = beyond


def crossing(codes: list[int]) -> list[int]:
    """The segment's least cost from each role to each, rows of four."""
    out = []
    for entry in STATES:
        cost = [NEVER] * 4
        cost[entry] = 0
        for code in codes:
            after = [NEVER] * 4
            for state in (START, SYSTEM, USER, ASSISTANT, USER):         # an insertion leads to user or assistant
                for _, c, used, nxt in MOVES[code][state]:
                    if not used:
                        cost[nxt] = min(cost[nxt], cost[state] + c)
            for state in STATES:
                for _, c, used, nxt in MOVES[code][state]:
                    if used:
                        after[nxt] = min(after[nxt], cost[state] + c)
            cost = after
        out += cost
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage of the contract: by
    crc32(``conv_id:turn``) % 20 a row is dropped, emptied, stripped of its
    sentence ends, repeated, or made a user's."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))), F.lit(20))
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("_kind"))
    text = (F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return (rows.where(F.col("_kind") != 0)
            .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy"))


def _key(col: str) -> Column:
    """The id as text; null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def _order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the key and the hash that the order of rows uses."""
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select(_key("conv_id").alias("key"), "turn", "role", "text", same.alias("same"))


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(key, seg, codes, blank, duplicate, truncated), stored: the rows of a
    conversation that lie in one run of ``size`` rows, a character each."""
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    lean = _order(rows).select("key", "turn", "role", "same", F.when(end == "", "").otherwise(F.right(end, F.lit(1))).alias("end"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "same"]
    lean = store(running_totals(lean, order, {}, "op11-order"), "op11-rows")
    # the first row of each role and text; joined on the place, which no rows share
    first = lean.groupBy("key", "same").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("first"))
    blank, seen = F.col("end") == "", F.col("first").isNull()
    cut = ~blank & ~seen & ~F.col("end").isin(".", "!", "?")
    fault = F.when(blank | seen, 2).when(cut, 1).otherwise(0)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS[:3]))
    code = F.char(65 + fault * len(INITIALS) + F.when((F.col("role") != "") & (initial > 0), initial - 1).otherwise(3))
    found = lean.join(first, "_pos", "left").select("key", "_pos", code.alias("code"), blank.alias("b"),
                                                    (~blank & seen).alias("d"), cut.alias("t"))
    gathered = F.array_sort(F.collect_list(F.struct("_pos", "code")))         # at most ``size`` rows
    return store(found.groupBy("key", F.floor(F.col("_pos") / size).alias("seg")).agg(
        F.array_join(F.transform(gathered, lambda x: x["code"]), "").alias("codes"),
        F.count_if("b").alias("blank"), F.count_if("d").alias("duplicate"), F.count_if("t").alias("truncated")), "op11-segments")


def _illegal(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:], strict=False)))


def _goals(segs: DataFrame) -> DataFrame:
    """(key, seg, goal): what follows each segment of a conversation of several, by last role."""
    def tables(rows):
        for key, seg, codes in rows:
            yield key, seg, crossing(codes_of(codes))

    def backwards(rows):
        now = None
        for key, seg, table in rows:
            if key != now:
                now, goal = key, ACCEPTED
            yield key, seg, goal
            goal = [min(table[4 * a + b] + goal[b] for b in STATES) for a in STATES]

    several = map_rows(segs.where("lo < hi").select("key", "seg", "codes"), tables, "key string, seg long, cross array<long>")
    dealt = several.repartition("key").sortWithinPartitions("key", F.col("seg").desc())
    return map_rows(dealt, backwards, "key string, seg long, goal array<long>")


def repairs(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Per key of the rows (conv_id, turn, role, text): steps, cost, illegal,
    blank, duplicate, truncated."""
    segs = segments(rows, size)
    segs = segs.join(segs.groupBy("key").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")), "key")
    asked = segs.join(_goals(segs), ["key", "seg"], "left").select(
        "key", "seg", "lo", "hi", "goal", "codes", "blank", "duplicate", "truncated")

    def searched(batch):
        for key, seg, lo, hi, goal, codes, *counts in batch:
            codes = codes_of(codes)
            initials = "".join(INITIALS[c % len(INITIALS)] for c in codes)
            for entry in (START,) if seg == lo else STATES:
                steps, leaves, cost = search(codes, entry, goal or ACCEPTED, seg == hi)
                yield (key, seg, entry, steps, leaves, cost, _illegal(initials), initials[0], initials[-1], *counts)

    def forwards(batch):
        now = None
        for key, seg, entry, steps, leaves, cost, illegal, first, last, *counts in batch:
            if key != now:
                now, state, at, before = key, START, seg, ""
            if seg != at:
                at, state, before = seg, then, ended
            if entry == state:
                then, ended = leaves, last
                yield key, seg, steps, cost, illegal + _illegal(before + first), *counts

    counts = "blank long, duplicate long, truncated long"
    tried = map_rows(asked, searched, "key string, seg long, entry int, steps string, exit int, cost long, illegal long, "
                                     f"first string, last string, {counts}")
    dealt = tried.repartition("key").sortWithinPartitions("key", "seg", "entry")
    chosen = map_rows(dealt, forwards, f"key string, seg long, steps string, cost long, illegal long, {counts}")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "steps"))), lambda x: x["steps"]), "")
    return chosen.groupBy("key").agg(whole.alias("steps"), *[F.sum(c).alias(c) for c in (
        "cost", "illegal", "blank", "duplicate", "truncated")])


def repair(rows: DataFrame, conversations: DataFrame | None = None, size: int = SEGMENT) -> DataFrame:
    """Per conversation of ``conversations`` (conv_id; those of the rows if not
    given): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of the rows (conv_id, turn, role, text)."""
    ids = (rows if conversations is None else conversations).select("conv_id").distinct()
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", "turn", *text)
    wide = "decimal(38,0)"
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn").cast(wide)
    gaps = rows.groupBy(_key("conv_id").alias("key")).agg(F.coalesce(span.cast("long"), F.lit(0)).alias("gaps"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    heads = (ids.withColumn("key", _key("conv_id")).join(gaps, "key", "left").join(repairs(rows, size), "key", "left")
             .select("key", F.lit(0).alias("kind"), F.struct("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
                                                             F.coalesce("steps", F.lit("")).alias("steps")).alias("head")))
    # a conversation's repair comes first, then its rows in order
    stream = (heads.unionByName(_order(rows).withColumn("kind", F.lit(1)), allowMissingColumns=True)
              .repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "role", "same")
              .select("key", "role", "text", "head.*"))

    def hashed(batch):
        head = None

        def line(role, text=""):
            nonlocal begun
            digest.update(f"{chr(10) * begun}{role}:{text}".encode())
            begun = True

        def ended():
            for step in head[-1][at:]:                   # insertions behind the last row
                line("user" if step == "u" else "assistant")
            return *head[:-1], head[-1].translate(EDITS), digest.hexdigest()

        for _, role, text, *row in batch:
            if role is None:
                if head is not None:
                    yield ended()
                head, at, digest, begun = row, 0, hashlib.sha256(), False
                continue
            while True:
                step, at = head[-1][at], at + 1
                if step in "ua":
                    line("user" if step == "u" else "assistant")
                    continue
                if step != "D":
                    line({"K": role, "U": "user", "A": "assistant"}[step], text)
                break
        if head is not None:
            yield ended()

    schema = T.StructType([ids.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in numbers],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return map_rows(stream, hashed, schema)
