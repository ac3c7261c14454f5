"""Operators 2 and 5: near duplicates and line spread against brute force."""

import random
import re

import numpy as np
import pytest

from nnprobe.llm.circulant_minhash import _prefix_pairs, banding, near_duplicates, shingle_sets, signatures
from nnprobe.llm.common import components
from nnprobe.llm.line_spread import drop_spread_lines
from nnprobe.llm.wordhash import PIECE, word_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, pct=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, _set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= pct * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, base_id, copies, words=120, edits=(0, 8)):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [(base_id, " ".join(base))]
    for k in range(1, copies):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], [f"e{rng.randrange(50)}"], [w[at], f"e{rng.randrange(50)}"]])
        out.append((base_id + k, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [r for f in range(5) for r in family(rng, 1000 * f, 25)]
    data += [(9000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))) for i in range(20)]
    rng.shuffle(data)
    want = brute_components(data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(data, DOCS)).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong                    # the families leave room for no missed link


@pytest.mark.parametrize("threshold, words, edits", [(70, 120, 4), (80, 100, 2)])
def test_pairs_just_above_other_thresholds(spark, threshold, words, edits):
    rng = random.Random(threshold)
    data = []
    for k in range(80):
        one = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        two = list(one)
        for j in range(edits):
            two[10 + 20 * j] = f"e{rng.randrange(10**6)}"
        a, b = _set(" ".join(one)), _set(" ".join(two))
        assert 0 <= 100 * len(a & b) - threshold * len(a | b) < 3 * len(a | b)
        data += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, DOCS), threshold_pct=threshold).collect()}
    assert got == {i: i - i % 2 for i in range(160)}


def test_banding_follows_the_threshold():
    assert banding(85)[:2] == (24, 7) and abs(banding(85)[2] - 0.74) < 1e-3
    for pct in range(1, 101):
        bands, rows, cut = banding(pct)
        assert (1 - (pct / 100) ** rows) ** bands <= 1e-4 and cut < pct / 100 or pct == 100


def test_edge_rows(spark):
    data = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"), (7, "a b c d e"),
            (None, "a b c d e"), (8, "É b c d e"), (9, "é b c d e")]
    df = spark.createDataFrame(data, DOCS).selectExpr("*", "'x' AS n", "1 AS label", "text AS bucket")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert len(got) == len(data)
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] and by[6] == [(1, 6, True)]
    assert by[7] == [(1, 7, True)] * 2 and by[None] == [(1, None, True)]
    assert by[8] == [(1, 8, True)] and by[9] == [(1, 9, True)]        # only A-Z are lowered
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_in_pieces():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    text = " ".join(words)
    assert len(text) > 2 * PIECE
    h, n = word_hashes([text, "w1 W1", None])
    assert n.tolist() == [200_000, 2, 0] and h[-1] == h[-2]
    assert h[12345] == word_hashes([words[12345]])[0][0]
    one, _ = shingle_sets([text])
    assert len(one) == 199_996


def test_signature_estimates_jaccard():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(2000)]
    other = list(base)
    for at in rng.sample(range(2000), 60):
        other[at] = f"x{at}"
    flat, sizes = shingle_sets([" ".join(base), " ".join(other)])
    a, b = set(flat[:sizes[0]].tolist()), set(flat[sizes[0]:].tolist())
    sig = signatures(flat, sizes)
    assert abs(float(np.mean(sig[0] == sig[1])) - len(a & b) / len(a | b)) < 0.12


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(5)
    data = family(rng, 0, 40, words=60, edits=(0, 10))
    flat, sizes = shingle_sets([t for _, t in data])
    ends = np.cumsum(sizes)
    sets = [set(flat[e - s:e].tolist()) for s, e in zip(sizes, ends)]
    rows = [(i, len(s), b"", [int(np.int64(np.uint64(x))) for x in sorted(s)]) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "rep long, n long, sk binary, shingles array<long>")
    act = spark.createDataFrame([(i, i) for i in range(len(sets))], "rep long, label long")
    got = {(r.a, r.b) for r in _prefix_pairs(act, table, 85).collect()}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want <= got


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in components(edges, "t").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100


LINES = "doc_id long, source string, text string, h long, at int"


def _spread(spark, data, **kw):
    df = spark.createDataFrame([(i, s, t, 1, 2) for i, s, t in data], LINES)
    return {(r.doc_id, r.text): (r._ls_text, r._ls_lines, r._ls_removed) for r in drop_spread_lines(df, **kw).collect()}


def test_lines_on_many_sites_stay_once(spark):
    common, rare = "Read the full terms on our site", "This line stands on four sites only"
    data = [(i, f"s{i}", f"own line number {i} of this\n{common}" + (f"\n{rare}" if i < 4 else "")) for i in range(5)]
    data += [(10 + i, "s1", "many times on one and the same site") for i in range(9)]
    got = {k[0]: v for k, v in _spread(spark, data).items()}
    assert common in got[0][0] and all(common not in got[i][0] for i in range(1, 5))
    assert all(rare in got[i][0] for i in range(4))
    assert all(got[10 + i][2] == 0 for i in range(9))
    assert got[4] == ("own line number 4 of this", 2, 1)


def test_line_edge_rows(spark):
    line = "one two three four five"
    data = [(1, None, line), (2, "a", line.upper() + " "), (3, "b", f"  {line}\n\nshort"), (4, "n", f"{line}\n{line}"),
            (5, "c", line), (None, "d", line), (6, "a", None), (7, "a", ""), (5, "c", line)]
    df = spark.createDataFrame([(i, s, t, 1, 2) for i, s, t in data], LINES)
    got = drop_spread_lines(df).collect()
    assert len(got) == len(data) and got[0].asDict().keys() >= {"h", "at"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r._ls_text, r._ls_lines, r._ls_removed))
    assert by[1] == [(line, 1, 0)]                              # the first place stays
    assert by[2] == [("", 1, 1)] and by[3] == [("\nshort", 3, 1)] and by[4] == [("", 2, 2)]
    assert by[5] == [("", 1, 1)] * 2
    assert by[None] == [(line, 1, 0)] and by[6] == [(None, 0, 0)] and by[7] == [("", 1, 0)]
    assert drop_spread_lines(df.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    line = "one two three four five"
    data = [(i, f"s{i}", line) for i in range(6)] + [(9, "s9", f"{line}\nmine"), (9, "s9", f"clean\n{line}"), (9, "s9", None)]
    data += [(0, "s0", f"another text\n{line}")]
    got = _spread(spark, data)
    assert got[9, f"{line}\nmine"] == ("mine", 2, 1) and got[9, f"clean\n{line}"] == ("clean", 2, 1)
    assert got[9, None] == (None, 0, 0)
    assert got[0, line] == (line, 1, 0) and got[0, f"another text\n{line}"] == ("another text", 2, 1)


def test_short_lines_are_judged(spark):
    data = [(i, f"s{i}", f"own {i}\nok\n全著作権所有\n \n") for i in range(5)]
    got = {k[0]: v[0] for k, v in _spread(spark, data).items()}
    assert got[0] == data[0][2] and all(got[i] == f"own {i}\n \n" for i in range(1, 5))
    assert _spread(spark, data, min_words=2)[1, data[1][2]][2] == 0


def test_lines_by_broadcast_and_by_salt_agree(spark, monkeypatch):
    from nnprobe.llm import line_spread
    data = [(i, f"s{i % 9}", f"own line of {i}\nfirst shared line\n" + ("second shared line\n" * (i % 3)) + "x" * (i % 2)) for i in range(80)]
    want = _spread(spark, data)
    monkeypatch.setattr(line_spread, "LINE_BROADCAST_ROWS", 0)
    assert _spread(spark, data) == want and sum(v[2] for v in want.values()) > 100


def test_exact_count_near_the_threshold(spark):
    data = [(i, f"s{i}", "a line that stands on fifty sites") for i in range(50)]
    data += [(100 + i, f"s{i}", "a line that stands on fortynine sites") for i in range(49)]
    got = {k[0]: v[2] for k, v in _spread(spark, data, min_sites=50).items()}
    assert sum(got[i] for i in range(50)) == 49 and sum(got[100 + i] for i in range(49)) == 0
