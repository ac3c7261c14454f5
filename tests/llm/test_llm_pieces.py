"""Operator 13 against the library's own encoder."""

import hashlib
import random

import pytest

from conftest import SF001
from nnprobe.llm import prefix_table as P
from nnprobe.llm.queries import QUERIES

PARTS = ["a", "b", "e", "t", "h", " ", "  ", "\n", "\t", "é", "中", "😀", "▁", "1", "00", "<s>", "<0x41>", "\x00", "ing", "   ",
         "日本", "न", "म", "́", "    ", "        ", " ", "ﬁ", "Ⅷ"]


@pytest.fixture(scope="module")
def table():
    with open(P.default_model(), "rb") as f:
        return P.PrefixTable(f.read())


def test_ids_are_the_librarys(table):
    rnd = random.Random(1)
    pieces = list(table.ids)
    texts = ["".join(rnd.choice(PARTS if k % 2 else pieces) for _ in range(rnd.randint(0, 20))) for k in range(6000)]
    for lo in range(0, len(texts), 100):
        for text, ids in zip(texts[lo:lo + 100], table.encode(texts[lo:lo + 100]), strict=True):
            assert ids == table.library.encode(text), text
            assert table.digits(ids) == ",".join(map(str, ids))


def test_long_stretches_take_time_of_their_length(table):
    text = "a" * 200_000 + "xyzzy" * 20_000 + " " * 50_001 + "中文" * 20_000
    assert table.encode([text]) == [table.library.encode(text)]


def test_pairs_are_those_that_merge_to_themselves(table):
    assert table.fits("", "▁the") and not table.fits("▁t", "he") and table.fits("▁the", "▁the")


def test_cache_is_bounded(table, monkeypatch):
    monkeypatch.setattr(P, "CACHED", 50)
    text = " ".join(f"word{i}" for i in range(400))
    table.words.new, table.words.old = {}, {}
    table.pairs = P.Sorted()
    for _ in range(2):
        assert table.encode([text, None, text]) == [table.library.encode(text), [], table.library.encode(text)]
    assert len(table.words.new) <= 50 and len(table.words.old) <= 50 and len(table.pairs.keys) <= 4 * 50 + 400


def test_encode_decode_and_edges(spark, table):
    texts = [None, "", " ", "hello world", "hello world", "  two  blanks ", "x\n\ty", "é中😀\x00", "long " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 AS ids", "8 AS `a.b`", "9 AS n_tokens")
    got = P.encode(df)
    assert got.columns == ["doc_id", "text", "a.b", "n_tokens", "ids"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i].ids == table.library.encode(t or "") for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in P.decode(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    odd = spark.createDataFrame([(0, None), (1, []), (2, [None, 9811])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in P.decode(odd).collect()} == {0: "", 1: "", 2: table.library.decode([9811])}
    trip = P.round_trip(df)
    assert trip.columns == ["doc_id", "ids", "a.b", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in trip.collect():
        ids = table.library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((table.library.decode(ids) if ids else "").encode()).hexdigest()
    assert P.round_trip(df.limit(0)).count() == 0


def test_given_documents(spark, table):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op13_prefix_table"](spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = table.library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(table.library.decode(ids).encode()).hexdigest()


def test_no_other_file_than_a_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "MAX_MODEL_BYTES", 10)
    (tmp_path / "big").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        P.model_of(spark, str(tmp_path / "big"))
