"""Recall (R1-R6).

Per query: hits / length of the truth list (an empty truth list gives 0).
Mean recall is taken over the *query set*, queries with empty truth included.

Sweep shortcut: with exact re-ranking under one total order, a truth row is
in the approximate top-k iff its list is probed, so hits(p) = number of truth
rows whose list has probe_rank <= p.  All efforts come from one pass over
truth x assignment x probe ranks; no approximate search is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.operators.ranking import grouped_percentiles, join_keys


def efforts_frame(spark, efforts) -> DataFrame:
    """(sweep_idx, effort) in the given order; the list itself is a parameter."""
    efforts = list(efforts)
    if not efforts or any(int(e) <= 0 for e in efforts):
        raise ValueError("efforts must be a non-empty list of positive ints")
    return spark.createDataFrame([(i, int(e)) for i, e in enumerate(efforts)],
                                 "sweep_idx int, effort int")


def per_query(ann: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, hits, truth_len, recall) for every query of the set."""
    t = truth.select("qid", "id")
    a = ann.select("qid", "id", F.lit(1).alias("_hit")).dropDuplicates(["qid", "id"])
    per = (t.join(a, ["qid", "id"], "left")
           .groupBy("qid")
           .agg(F.count(F.col("_hit")).alias("hits"), F.count("*").alias("truth_len")))
    return (queries.select("qid").join(per, "qid", "left")
            .select("qid",
                    F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
                    F.coalesce("truth_len", F.lit(0)).cast("long").alias("truth_len"))
            .withColumn("recall", F.when(F.col("truth_len") > 0,
                                         F.col("hits") / F.col("truth_len")).otherwise(F.lit(0.0))))


def mean_recall(per: DataFrame) -> DataFrame:
    """R2: average over the query set."""
    return per.agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))


MAX_BROADCAST_TRUTH = 5_000_000      # rows of 16 bytes


def sweep(truth: DataFrame, assignment: DataFrame, probes: DataFrame,
          queries: DataFrame, efforts: DataFrame, truth_rows: int | None = None) -> DataFrame:
    """(qid, sweep_idx, effort, hits, truth_len, recall) for every
    query and effort, from the shortcut."""
    # with a known small size (queries x k rows) truth is the broadcast side and
    # the table-sized assignment is streamed past it; otherwise Spark decides.
    # Truth rows without a list (none in practice) still count in truth_len.
    t = truth.select("qid", "id")
    tb = F.broadcast(t) if truth_rows is not None and truth_rows <= MAX_BROADCAST_TRUTH else t
    located = assignment.select("id", "list_id").join(tb, "id")
    ranked = located.join(probes.select("qid", "list_id", "probe_rank"), ["qid", "list_id"], "left")
    hits = (ranked.crossJoin(F.broadcast(efforts))
            .groupBy("qid", "sweep_idx", "effort")
            .agg(F.count_if(F.col("probe_rank") <= F.col("effort")).alias("hits")))
    tl = t.groupBy("qid").agg(F.count("*").alias("truth_len"))
    per = (tl.crossJoin(F.broadcast(efforts))
           .join(hits, ["qid", "sweep_idx", "effort"], "left"))
    grid = queries.select("qid").crossJoin(F.broadcast(efforts))
    return (grid.join(per, ["qid", "sweep_idx", "effort"], "left")
            .select("qid", "sweep_idx", "effort",
                    F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
                    F.coalesce("truth_len", F.lit(0)).cast("long").alias("truth_len"))
            .withColumn("recall", F.when(F.col("truth_len") > 0,
                                         F.col("hits") / F.col("truth_len")).otherwise(F.lit(0.0))))


def sweep_points(per: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """R2 over R3: one row per effort, in sweep order."""
    pts = per.groupBy("sweep_idx", "effort").agg(F.avg("recall").alias("recall"),
                                                 F.count("*").alias("queries"))
    if cost is not None:
        c = cost.groupBy("sweep_idx").agg(F.avg("scanned").alias("scanned_per_query"))
        pts = pts.join(c, "sweep_idx", "left")
    return pts


def default_point(points: DataFrame, default_effort: int | None) -> DataFrame:
    """The first point, replaced by the last point whose effort equals the
    index default (when that default is > 0)."""
    d = int(default_effort or 0)
    match = (F.col("effort") == F.lit(d)) & F.lit(d > 0)
    key = F.struct(match.alias("m"),
                   F.when(match, F.col("sweep_idx")).otherwise(-F.col("sweep_idx")).alias("o"))
    cols = [c for c in points.columns]
    best = points.agg(F.max_by(F.struct(*cols), key).alias("p"))
    return best.select("p.*")


# Index kinds recall is measured for (fixed).
ANN_KINDS = ("hnsw", "ivfflat")
GATE_WARNING = "recall not measured: without an approximate index every search is exact"


def gate(lookup: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per looked-up index: ``run`` (recall is measured) and a
    warning when the kind is not an ANN index or the query set is empty."""
    n = queries.agg(F.count("*").alias("n_queries"))
    ok_kind = F.col("kind").isin(*ANN_KINDS)
    return (lookup.select("kind").crossJoin(n)      # one row each
            .select("kind", "n_queries",
                    (ok_kind & (F.col("n_queries") > 0)).alias("run"),
                    F.when(~ok_kind, F.lit(GATE_WARNING)).alias("warning")))


def sweep_timings(m: DataFrame) -> DataFrame:
    """Per effort, p95 of the per-query durations and queries / wall
    time, from measurement rows labelled ``sweep_idx`` and ``effort``."""
    keys = ["sweep_idx", "effort"]
    g = m.groupBy(*keys).agg(F.count("*").alias("queries"),
                             ((F.max("ended_us") - F.min("started_us")) / 1e6).alias("wall_s"))
    p = grouped_percentiles(m, keys, "dur_ms", (0.95,), ("p95_ms",))
    return (join_keys(g, p, keys, "left").select(*keys, "p95_ms", "queries", "wall_s")
            .withColumn("qps", F.when(F.col("wall_s") > 0, F.col("queries") / F.col("wall_s")).otherwise(F.lit(0.0))))


def timed_points(points: DataFrame, timings: DataFrame) -> DataFrame:
    """R3 in full: recall points with p95 and queries per second of their effort."""
    return points.join(timings.select("sweep_idx", "p95_ms", "qps"), "sweep_idx", "left")
