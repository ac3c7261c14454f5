"""Operator 11 against a plain search over all edits."""

import functools
import hashlib
import random
import re
import sys
import zlib

from conftest import SF001
from nnprobe.llm import conversation_repair as C
from nnprobe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen = set()
    for _, _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        yield ("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))


def cheapest(rows, faults):
    @functools.cache
    def best(i, last, inserted):
        ask = "a" if last == "u" else "u"
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            cost, audit, lines = best(i, ask, inserted + 1)
            options.append((cost + 2, "I" + audit, (NAMES[ask] + ":", *lines)))
        if i < len(rows):
            role, text = rows[i][2:]
            cost, audit, lines = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                cost, audit, lines = best(i + 1, ask, 0)
                options.append((cost + 2 + more, "R" + audit, (f"{NAMES[ask]}:{text}", *lines)))
                if role[:1] == ask or (role[:1] == "s" and last == ""):
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows, ids):
    out = []
    for c in ids:
        of = sorted((r for r in rows if r[0] == c), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()))
        faults = list(faults_of(of))
        cost, audit, lines = cheapest(of, faults)
        turns = [r[1] for r in of if r[1] is not None]
        initials = [r[2][:1] for r in of]
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, conversations, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(conversations)]), rnd.choice([None, *range(60)]) if rnd.random() < 0.4 else i,
             rnd.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "urgh"]),
             rnd.choice([None, "", "hi.", "ok", "yes!", "no? ", "a b c", "Ω\n", " ", "x" * 5000 + "."])) for i in range(n)]
    return rows + rows[:3]               # rows alike in all columns


def test_repair_equals_brute_force_in_segments_of_any_size(spark):
    sys.setrecursionlimit(20_000)
    for n, conversations, size in ((0, 1, 4), (1, 1, 1), (200, 30, 3), (260, 2, 5), (300, 2, 1024)):
        rows = made(n, conversations, n)
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS _pos", "3 AS steps")      # clashing names
        got = sorted((tuple(r) for r in C.repair(C.damaged(df), df, size).collect()), key=str)
        assert got == brute(damage(rows), {r[0] for r in rows}), (n, conversations, size)


def test_search_is_the_ascii_least_of_the_cheapest():
    rnd = random.Random(4)
    words = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    for _ in range(300):
        codes = [rnd.randrange(12) for _ in range(rnd.randint(1, 9))]
        rows = [(0, i, words[C.INITIALS[c % 4]], f"t{i}") for i, c in enumerate(codes)]
        faults = [("", "truncated", "blank")[c // 4] for c in codes]
        steps, _, cost = C.search(codes, C.START, C.ACCEPTED, True)
        assert (cost, steps.translate(C.EDITS)) == cheapest(rows, faults)[:2]


def test_long_conversations_are_searched_in_time_of_their_length():
    rnd = random.Random(1)
    for codes in ([rnd.randrange(12) for _ in range(1024)], [0] * 1024, [1] * 1024, [8] * 1024, [3] * 1024):
        goal = C.search(codes, C.START, C.ACCEPTED, True)[2]
        cross = C.crossing(codes)
        assert goal == min(cross[b] + C.ACCEPTED[b] for b in C.STATES)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_conversation_repair"](spark, SF001).collect()), key=str)
    assert got == brute(damage(rows), {r[0] for r in rows})
