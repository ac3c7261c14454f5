"""Benchmark decontamination by a distributed positional inverted index
(operator 9), DataFrame functions only.

The benchmark is a stated query set, taken in blocks of bounded size; the
training side is never broadcast.  Per block:

1. corpus frequencies of the block's terms (one pass, partial counts);
2. every window of ten words (a shorter item is one window) is anchored at
   its rarest terms; windows with a term the corpus lacks cannot occur;
3. the index: postings (term, document, position) of the anchor terms over
   all documents, with the words around the rarest ones, are stored in the
   shared folder;
4. the rarest term's list, shifted by its offset in the window, is
   intersected with the shifted list of the second rarest one; the words
   around the posting confirm the exact phrase.

``proximity_matches`` reads the same lists without the exact order: the two
rarest terms of a window at most ``slop`` words off their places.

Edge cases: null or word-free texts and items have no words and match
nothing; equal items each count; repeated rows and rows that share a doc_id
pool their hits and each get the pooled figures with their own n_words; rows
with a null doc_id are kept as not contaminated; a null item_id counts as an
item but is left out of the digest.  Positions are held per posting, never
per document, so long texts are no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nnprobe.llm.common import LOWER, UPPER, drop_stored, store

SIZE = 10
BLOCK_BYTES = 2 << 20      # bytes of item text per block; its windows, the largest broadcast, take about 40 times that
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z only.  lower() does the same, faster, on texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def word_count(text: Column) -> Column:
    """Number of words; case makes no difference."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD_ANY_CASE), "")).cast("long")


def item_windows(bench: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, words): every window of each item."""
    w = bench.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    return (w.select("item_id", "all", F.explode(starts).alias("s"))
            .select("item_id", F.slice("all", F.col("s"), size).alias("words")).distinct())


def _tokens(docs: DataFrame) -> DataFrame:
    w = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    return w.select("doc_id", "words", F.posexplode("words").alias("pos", "term"))


def build_index(docs: DataFrame, windows: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(anchors, postings) of one block of windows, both stored.

    anchors: wid, words, t1, o1, t2, o2 (rarest and second rarest term of the
    window with their offsets; t2 null where the window has one term).
    postings: term, doc_id, pos, around, lead (the words around the posting
    of a rarest term, and how many of them come before it)."""
    wins = windows.select("words").distinct().withColumn("wid", F.xxhash64("words"))
    terms = wins.select("wid", F.posexplode("words").alias("off", "term"))
    vocabulary = F.broadcast(terms.select("term").distinct())     # at most one block
    freq = _tokens(docs).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("cf"))
    firsts = terms.groupBy("wid", "term").agg(F.min("off").alias("off"))
    ranked = (firsts.join(freq, "term", "left").groupBy("wid")
              .agg(F.sort_array(F.collect_list(F.struct("cf", "term", "off"))).alias("r"))   # at most ten each
              .where(F.col("r")[0]["cf"].isNotNull()))
    anchors = store(wins.join(ranked, "wid").select(
        "wid", "words", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["off"].alias("o1"),
        F.get("r", F.lit(1))["term"].alias("t2"), F.get("r", F.lit(1))["off"].alias("o2")), "op9-anchors")
    wanted = (anchors.select(F.col("t1").alias("term"), F.lit(True).alias("rarest"))
              .unionAll(anchors.where(F.col("t2").isNotNull()).select(F.col("t2").alias("term"), F.lit(False).alias("rarest")))
              .groupBy("term").agg(F.max("rarest").alias("rarest")))
    lead = F.least(F.col("pos"), F.lit(size - 1))
    postings = store(_tokens(docs).join(F.broadcast(wanted), "term").select(
        "term", "doc_id", F.col("pos").cast("long").alias("pos"), lead.alias("lead"),
        F.when(F.col("rarest"), F.slice("words", F.col("pos") - lead + 1, 2 * size - 1)).alias("around")), "op9-postings")
    return anchors, postings


def exact_matches(anchors: DataFrame, postings: DataFrame) -> DataFrame:
    """(wid, doc_id, start, n): exact occurrences of windows."""
    small = F.broadcast(anchors)                                  # at most one block
    one = (postings.where(F.col("around").isNotNull())
           .join(small, F.col("term") == F.col("t1"))
           .select("wid", "doc_id", (F.col("pos") - F.col("o1")).alias("start"), "t2", "words",
                   F.slice("around", F.greatest(F.col("lead") - F.col("o1") + 1, F.lit(1)), F.size("words")).alias("found"))
           .where(F.col("start") >= 0))
    two = (postings.join(F.broadcast(anchors.select("wid", "t2", "o2")), F.col("term") == F.col("t2"))
           .select("wid", "doc_id", (F.col("pos") - F.col("o2")).alias("start")))
    hit = one.where(F.col("t2").isNotNull()).join(two, ["wid", "doc_id", "start"], "left_semi").select(one.columns)
    alone = one.where(F.col("t2").isNull())
    return (hit.unionAll(alone).where(F.col("found") == F.col("words"))
            .select("wid", "doc_id", "start", F.size("words").alias("n")))


def proximity_matches(anchors: DataFrame, postings: DataFrame, slop: int = 5) -> DataFrame:
    """(wid, doc_id, start, shift): the rarest term's postings for which the
    window's second rarest term lies within ``slop`` words of its place
    (``shift`` = least distance off).  Bins of ``slop`` + 1 words make it an
    equi-join."""
    width = slop + 1
    one = (postings.join(F.broadcast(anchors.where(F.col("t2").isNotNull())), F.col("term") == F.col("t1"))
           .select("wid", "doc_id", (F.col("pos") - F.col("o1")).alias("start")))
    one = one.withColumn("bin", F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])))
    two = (postings.join(F.broadcast(anchors), F.col("term") == F.col("t2"))
           .select("wid", "doc_id", (F.col("pos") - F.col("o2")).alias("other")))
    two = two.withColumn("bin", F.floor(F.col("other") / width))
    return (one.join(two, ["wid", "doc_id", "bin"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
            .groupBy("wid", "doc_id", "start").agg(F.min(F.abs(F.col("start") - F.col("other"))).alias("shift")))


def benchmark_blocks(bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The query set cut by item hash so that a block's text stays near ``block_bytes``."""
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-total // block_bytes)) or 1
    return [bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, bench: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    bench = bench.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in benchmark_blocks(bench, block_bytes):
        windows = store(item_windows(block, size), "op9-windows")
        anchors, postings = build_index(docs, windows, size)
        hits = store(exact_matches(anchors, postings), "op9-hits")
        named = windows.select("item_id", F.xxhash64("words").alias("wid"))
        # hit words: distinct positions; items: distinct names through the windows
        pos = hits.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct()
        items = hits.select("doc_id", "wid").distinct().join(named, "wid").select("doc_id", "item_id").distinct()
        drop_stored(postings)
        found = (pos, items) if found is None else (found[0].unionAll(pos), found[1].unionAll(items))
    pos, items = found
    n_hit = pos.distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    n_items = items.distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.col("item_id").cast("string")))).alias("names"))
    marked = store(n_hit.join(n_items, "doc_id"), "op9-marked")
    out = docs.select("doc_id", word_count(F.col("text")).alias("n_words")).join(marked, "doc_id", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
