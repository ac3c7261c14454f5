"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

Targets: the sources, by code point and nulls last, weigh 3, 1, 2, repeating;
they share 150 % of all words, no source above twice its own; the excess is
shared again by weight.  Each source's documents are shuffled by hash into one
stream of words, read at most twice, and the stream is cut into blocks of
equal size.  Slot i of the mix is the i-th golden-ratio point (i * g mod 1);
the cumulative target shares map it to a source, and the r-th slot of a source
takes its r-th block.  A source the points leave a few blocks short gets them
at the end; a surplus slot stays empty.  So any stretch of the mix has the
target proportions, and each source gives exactly its target, rounded down.

Edge cases: null and word-free texts have size 0 and are never taken; a null
source is a source; repeated rows each have a place in the stream; an empty
table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.llm.common import running_totals, store

WEIGHTS = (3, 1, 2)
SHARE = 1.5            # words of the mix per word of the sources
MAX_REPEAT = 2         # times a source may be read
BLOCK_WORDS = 1024
RING = 1 << 31
GOLDEN = 1327217885    # odd, nearest to RING times the golden ratio's fraction
SEED = 42


def _count_words(batches):
    for batch in batches:
        n = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())],
                                         names=["doc_id", "source", "size"])


def water_fill(sources: DataFrame) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``.  The level
    (words per weight) only rises; each round fixes the sources it fills."""
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, level, filled = SHARE * (total[0] or 0), 0.0, -1
    if total[1]:
        level = goal / total[1]
    full = F.lit(MAX_REPEAT) * F.col("source_size")
    while True:
        over = full <= F.lit(level) * F.col("weight")
        row = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, full)),
                          F.sum(F.when(~over, F.col("weight")))).first()
        if row[0] == filled or not row[2]:
            break
        filled, level = row[0], (goal - (row[1] or 0)) / row[2]
    return sources.withColumn("target", F.least(full.cast("double"), F.lit(float(level)) * F.col("weight")))


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: sid (rank by code point, nulls last), weight, source_size, first (words before it), target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(totals, [F.col("source").asc_nulls_last()], {"first": "source_size"}, "op4-sources")
    kind = F.pmod(F.col("_pos"), F.lit(len(WEIGHTS))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), kind + 1)
    return store(water_fill(ranked.withColumn("weight", weight).withColumnRenamed("_pos", "sid")), "op4-targets")


def slots(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, sid, rank): the schedule; every source has as many ranks as its target has blocks."""
    want = targets.where(F.floor("target") > 0).select(
        "sid", "target", F.ceil(F.floor("target") / block_words).cast("long").alias("blocks"))
    row = want.agg(F.sum("blocks"), F.sum("target"), F.count("*")).first()
    n, share, kinds = row[0] or 0, row[1] or 1.0, row[2]
    spark = targets.sparkSession
    # arcs of the ring in source order, cut at cell borders: points meet arcs by cell
    cells = 1 << max(4, math.ceil(math.log2(max(4 * kinds, 1))))
    width = RING // cells
    ends = running_totals(want, ["sid"], {"below": "target"}, "op4-arcs")
    lo = F.round(F.col("below") / F.lit(share) * RING).cast("long")
    hi = F.round((F.col("below") + F.col("target")) / F.lit(share) * RING).cast("long")
    arcs = (ends.select("sid", "blocks", lo.alias("lo"), hi.alias("hi")).where(F.col("lo") < F.col("hi"))
            .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))))
    points = (spark.range(n).withColumn("at", F.pmod(F.pmod(F.col("id") + 1, F.lit(RING)) * GOLDEN, F.lit(RING)))
              .withColumn("cell", F.floor(F.col("at") / width)))
    hit = (points.join(arcs, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
           .select(F.col("id").alias("slot"), "sid"))
    ordered = store(running_totals(hit, ["sid", "slot"], {}, "op4-points"), "op4-ranks")
    first = ordered.groupBy("sid").agg(F.min("_pos").alias("p0"), F.count("*").alias("got"))
    ranked = (ordered.join(first, "sid").join(want.select("sid", "blocks"), "sid")
              .select("slot", "sid", (F.col("_pos") - F.col("p0")).alias("rank"), "blocks")
              .where(F.col("rank") < F.col("blocks")).drop("blocks"))
    short = (want.join(first, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
             .where(F.col("got") < F.col("blocks"))
             .select("sid", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("rank")))
    return ranked.unionAll(short.select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces), both stored.

    placed: doc_id, source, size, sid, source_size, target, start (place in
    the source's stream) of every row.  pieces: slot, sid, rank, start,
    doc_id, pass, from_word, to_word: the mix, slot by slot."""
    base = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))
    schema = base.select("doc_id", "source").schema.add("size", "long")
    sized = store(base.mapInArrow(_count_words, schema), "op4-sizes")
    targets = source_targets(sized)
    stream = running_totals(sized.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(seed))),
                            [F.col("source").asc_nulls_last(), "_h", "doc_id", "size"], {"_start": "size"}, "op4-stream")
    t = targets.select(F.col("source").alias("_source"), "sid", "source_size", "target", "first")
    placed = store(stream.join(t, F.col("source").eqNullSafe(F.col("_source")))
                   .select("doc_id", "source", "size", "sid", "source_size", "target",
                           (F.col("_start") - F.col("first")).alias("start")), "op4-placed")
    goal = F.floor("target").cast("long")
    parts = None
    for turn in range(MAX_REPEAT):
        part = (placed.withColumns({"pass": F.lit(turn), "lo": F.col("start") + F.lit(turn) * F.col("source_size")})
                .withColumn("hi", F.least(F.col("lo") + F.col("size"), goal)).where(F.col("lo") < F.col("hi")))
        parts = part if parts is None else parts.unionAll(part)
    b = F.lit(block_words)
    parts = parts.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / b), F.floor((F.col("hi") - 1) / b))))
    skipped = F.col("lo") - F.greatest("lo", F.col("rank") * b)      # minus words before this block
    pieces = parts.select("sid", "rank", "start", "doc_id", "pass", (-skipped).alias("from_word"),
                          (F.least(F.col("hi"), (F.col("rank") + 1) * b) - F.col("lo")).alias("to_word"))
    return placed, store(pieces.join(slots(targets, block_words), ["sid", "rank"]), "op4-pieces")


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per row of the input: doc_id, size, source_size, target, taken."""
    got = pieces.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("got"))
    has = F.col("size") > 0        # rows of size 0 share their start with the next row
    return (placed.join(got, ["sid", "start"], "left")
            .select("doc_id", "size", "source_size", "target",
                    F.when(has, F.coalesce("got", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"), "source"))
