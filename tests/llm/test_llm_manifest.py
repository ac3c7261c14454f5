"""Operator 12 against trees built level by level in plain Python."""

import hashlib
import random
import zlib

from nnprobe.llm import merkle_manifest as M
from nnprobe.llm.common import store
from nnprobe.llm.queries import tampered_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), i % 2
        i //= 2


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    of = {k: sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in keys}
    trees = {k: levels_of([leaf(r) for r in of[k]]) for k in keys}
    top = levels_of([trees[k][-1][0] for k in keys])
    out = []
    for t, k in enumerate(keys):
        for i, r in enumerate(of[k]):
            steps = [*path(trees[k], i), *path(top, t)]
            now = list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now[3] += 1
            got = leaf(now)
            for other, right in steps:
                got = h(got) if other is None else h(other, got) if right else h(got, other)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*[s for s, _ in steps if s]), got, got == top[-1][0]))
    return sorted(out, key=str)


def made(n):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, rnd.randint(0, n)]) if rnd.random() < 0.2 else i, rnd.choice([None, "a", "é"]),
             rnd.choice([None, "", "en", "en", "en", "de", "zz"][:1 + n % 7]), rnd.choice([None, i, 2**63 - 1]),
             rnd.choice([None, "", "txt é\n", "long " * 9000])) for i in range(n)]
    return rows + rows[:3]               # rows alike in all columns


def test_manifest_equals_plain_trees(spark):
    for n, levels in ((0, 3), (1, 2), (2, 1), (50, 2), (200, 3), (333, 12)):
        rows = made(n)
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS _pos", "3 AS digest", "4 AS leaf")
        assert sorted((tuple(r) for r in tampered_manifest(df, levels).collect()), key=str) == brute(rows), (n, levels)


def test_trees_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    rows = made(90)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(M, "TREE_BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in tampered_manifest(df, 3).collect()), key=str) == brute(rows)


def test_places_are_those_of_a_postorder_walk():
    def walk(level, index, n):
        if level:
            for child in range(index * M.FAN, min((index + 1) * M.FAN, -(-n // M.FAN**(level - 1)))):
                yield from walk(level - 1, child, n)
        yield level, index

    for n in range(1, 70):
        assert [M.log_place(level, i, n) for level, i in walk(M.height(n), 0, n)] == list(range(M.subtree_size(n, M.height(n))))


def test_log_is_gapless_and_pages_are_pieces_of_it(spark):
    n = 77
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    leaves = store(spark.createDataFrame([(5, i, n, bytearray(d)) for i, d in enumerate(digests)],
                                         "tree long, idx long, n long, digest binary"), "test-leaves")
    rounds, roots = M.build_log(leaves, "test-log", 2)
    rows = [r for log in rounds for r in log.collect()]
    assert len(rounds) > 2 and sorted(r.place for r in rows) == list(range(M.subtree_size(n, M.height(n))))
    want = levels_of([d.hex() for d in digests])
    assert all(bytes(r.digest).hex() == want[r.level][r.idx] for r in rows)
    assert bytes(roots.first().root).hex() == want[-1][0]
    pages = {}
    for r in rounds[0].collect():
        pages.setdefault(r.page, []).append(r.place)
    assert all(sorted(p) == list(range(min(p), min(p) + len(p))) for p in pages.values())
    # proofs of a few leaves alone
    few = M.extract_proofs(rounds, leaves.where("idx IN (0, 40, 76)"), 2).collect()
    for r in few:
        proof = bytes(r.proof)
        steps = iter([proof[i:i + 32] for i in range(0, len(proof), 32)])
        assert M.fold(bytes(r.digest), r.idx, n, steps).hex() == want[-1][0] and next(steps, None) is None
    assert len(few) == 3


def test_log_only_grows_at_its_end(spark):
    def log_of(n):
        rows = [(0, i, n, bytearray(hashlib.sha256(str(i).encode()).digest())) for i in range(n)]
        rounds, _ = M.build_log(store(spark.createDataFrame(rows, "tree long, idx long, n long, digest binary"), "grow"), "grow", 3)
        return {r.place: bytes(r.digest) for log in rounds for r in log.collect()}

    small, large = log_of(32), log_of(45)
    assert all(large[p] == d for p, d in small.items())      # 32 is a closed subtree of 45


def test_proofs_are_folded_in_the_task_that_picks_them(spark):
    """One Python worker a task: the result's plan has one Python step above its last shuffle."""
    df = spark.createDataFrame([(i, "s", f"l{i % 3}", i, f"t{i}") for i in range(40)],
                               "doc_id long, source string, lang string, n_chars long, text string")
    plan = tampered_manifest(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange")[0].count("MapInArrow") == 1
