"""Measurement statistics (M1-M12) over tables of timed queries.

Measurement rows: ``run_id, phase, level, worker, seq, started_us, ended_us,
dur_ms`` (plus ``warmup``).  Exact percentiles interpolate linearly at
p * (n - 1), as the reference does; equal durations are counted first and
ranked by ranges (``ranking.grouped_percentiles``), so neither a level nor a
phase is ever one task.  NULL levels and phases are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.operators.ranking import explode_range, grouped_percentiles, join_keys, positions, running
from nnprobe.session import stored

# Fixed values of the reference's statistics.
PERCENTILES = (0.5, 0.95, 0.99)
WARMUP = 50            # queries run first and not timed
TICKS = 50             # running percentiles every max(1, Q/50) queries
SATURATION_GAIN = 0.1  # gain below 10 % = saturated
PROGRESS_STEPS = 10    # progress printed per tenth


def quantize_ms(dur_ns):
    """Whole microseconds (truncated) / 1000 -> milliseconds."""
    c = F.col(dur_ns) if isinstance(dur_ns, str) else dur_ns
    return F.floor(c / 1000).cast("long") / 1000.0


def epoch_us(df: DataFrame, col: str):
    """Microseconds since the epoch, independent of the session time zone:
    a TIMESTAMP_NTZ wall clock is read as UTC, a TIMESTAMP is an instant."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))


def from_events(ev: DataFrame, run_id: str = "events") -> DataFrame:
    """Read the driver's ``events`` table as measurement rows: level and
    phase = event_type, worker = user_id, seq = event_id, end = ts,
    duration = value ms (start = end - duration)."""
    ended = epoch_us(ev, "ts")
    dur_us = F.round(F.col("value") * 1000).cast("long")
    return ev.select(F.lit(run_id).alias("run_id"), F.col("event_type").alias("phase"),
                     F.col("event_type").alias("level"), F.col("user_id").alias("worker"),
                     F.col("event_id").alias("seq"), ended.alias("ended_us"),
                     (ended - dur_us).alias("started_us"), F.col("value").alias("dur_ms"))


def with_warmup(m: DataFrame, group: str = "level", warmup: int = WARMUP) -> DataFrame:
    """M9: flag the first min(warmup, n) rows of each group by seq.

    Top-``warmup`` per group is a bounded window limit (every map task keeps
    at most ``warmup`` rows of a group), then its largest seq is the cut."""
    w = Window.partitionBy(group).orderBy("seq")
    first = m.select(group, "seq").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= warmup)
    cut = first.groupBy(group).agg(F.max("seq").alias("_cut"))
    return (join_keys(m, cut, [group], "left")
            .withColumn("warmup", F.coalesce(F.col("seq") <= F.col("_cut"), F.lit(False))).drop("_cut"))


def latency_summary(m: DataFrame, group=("run_id", "phase")) -> DataFrame:
    """M1-M2: count, mean, p50, p95, p99 per group (0 when empty)."""
    names, group = ("p50_ms", "p95_ms", "p99_ms"), list(group)
    g = grouped_percentiles(m, group, "dur_ms", PERCENTILES, names,
                            extra={"count": F.count("dur_ms"), "mean_ms": F.avg("dur_ms")})
    return g.select(*group, "count", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mean_ms", *names)])


def levels(m: DataFrame, run: str = "run_id") -> DataFrame:
    """M3-M4: one row per level: level_idx (order of first appearance),
    concurrency (distinct workers), total_queries, duration_ns (first start
    to last end), qps = total / elapsed seconds, p95_ms over all workers."""
    agg = m.groupBy(run, "level").agg(
        F.min("seq").alias("_first"), F.count_distinct("worker").cast("int").alias("concurrency"),
        F.count("*").alias("total_queries"),
        ((F.max("ended_us") - F.min("started_us")) * 1000).alias("duration_ns")).checkpoint(eager=True)     # one row a level
    agg = join_keys(agg, grouped_percentiles(m, [run, "level"], "dur_ms", (0.95,), ("p95_ms",)), [run, "level"], "left")
    # one row per level from here on
    w = Window.partitionBy(run).orderBy("_first", "level")
    return (agg.withColumn("level_idx", (F.row_number().over(w) - 1).cast("int"))
            .withColumn("qps", F.when(F.col("duration_ns") > 0,
                                      F.col("total_queries") / (F.col("duration_ns") / 1e9)).otherwise(F.lit(0.0)))
            .select(run, "level_idx", "level", "concurrency", "total_queries", "duration_ns", "qps", "p95_ms"))


def peak(lv: DataFrame, run: str = "run_id") -> DataFrame:
    """M5: highest qps, first maximum in list order; all zero -> 0 at level 0."""
    best = lv.groupBy(run).agg(
        F.max_by(F.struct("qps", "concurrency", "level_idx"),
                 F.struct(F.col("qps"), -F.col("level_idx"))).alias("_b"))
    pos = F.col("_b.qps") > 0
    return best.select(run,
                       F.when(pos, F.col("_b.qps")).otherwise(F.lit(0.0)).alias("peak_qps"),
                       F.when(pos, F.col("_b.concurrency")).otherwise(F.lit(0)).alias("peak_level"),
                       F.when(pos, F.col("_b.level_idx")).otherwise(F.lit(None).cast("int")).alias("peak_level_idx"))


def saturation(lv: DataFrame, run: str = "run_id") -> DataFrame:
    """M6: in list order, the first level whose qps gain over the previous
    level is below 10 % (previous qps > 0) -> the previous level's
    concurrency; none -> the peak level."""
    w = Window.partitionBy(run).orderBy("level_idx")
    g = (lv.withColumn("_pq", F.lag("qps").over(w)).withColumn("_pc", F.lag("concurrency").over(w))
         .where((F.col("_pq") > 0) & ((F.col("qps") - F.col("_pq")) / F.col("_pq") < SATURATION_GAIN)))
    first = g.groupBy(run).agg(F.min_by("_pc", "level_idx").alias("_sat"))
    pk = peak(lv, run)
    return (pk.join(first, run, "left")
            .select(run, "peak_qps", "peak_level",
                    F.coalesce("_sat", "peak_level").cast("int").alias("saturated_at")))


BINS = 256             # slices of a group's sorted durations (running percentiles)
MAX_BIN_ROWS = 200_000


def running_percentiles(m: DataFrame, group: str = "level", ticks: int = TICKS) -> DataFrame:
    """M7: p50/p95 of all durations so far, every max(1, Q/ticks) queries and
    at the last one (``done`` = queries completed at the tick).

    Each row gets its tick (position by seq) and its bin (position by
    duration).  Counts per (bin, tick) tell in which bin a tick's rank lies;
    only that bin's rows are then ranked, so all ticks together look at about
    as many rows as the table has.
    """
    p = positions(m.select(group, "seq", "dur_ms").where(F.col("dur_ms").isNotNull()), group, "seq", "done")
    p = positions(p, group, ["dur_ms", "seq"], "by_value")
    tot = (m.where(F.col("dur_ms").isNotNull()).groupBy(group).agg(F.count("*").alias("q"))
           .withColumn("every", F.greatest(F.lit(1), F.floor(F.col("q") / ticks)).cast("long"))
           .withColumn("width", F.least(F.ceil(F.col("q") / BINS), F.lit(MAX_BIN_ROWS))))
    # tick j sits at done = 1 + j * every; the last tick is at done = q
    x = join_keys(p, tot, [group]).select(
        group, "dur_ms", "by_value", F.ceil((F.col("done") - 1) / F.col("every")).cast("long").alias("tick"),
        F.floor((F.col("by_value") - 1) / F.col("width")).alias("bin"))
    x, _ = stored(x, "ticks")
    last = F.ceil((F.col("q") - 1) / F.col("every")).cast("long")
    at = tot.select(group, "q", "every", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tick"))
    at = at.withColumn("done", F.least(1 + F.col("tick") * F.col("every"), F.col("q")))
    # counts per (group, bin, tick), then of all rows up to each tick
    cells = x.groupBy(group, "bin", F.col("tick").alias("first")).agg(F.count("*").alias("c"))
    upto = (join_keys(at.select(group, "tick"), cells, [group]).where(F.col("first") <= F.col("tick"))
            .groupBy(group, "tick", "bin").agg(F.sum("c").alias("c")))
    w = Window.partitionBy(group, "tick").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = upto.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    ranks = [F.struct(F.lit(n).alias("name"), f(F.lit(q) * (F.col("done") - 1)).cast("long").alias("rank"))
             for q, names in ((0.5, ("f50", "g50")), (0.95, ("f95", "g95"))) for n, f in zip(names, (F.floor, F.ceil), strict=True)]
    want = at.select(group, "tick", "done", F.explode(F.array(*ranks)).alias("r")).select(group, "tick", "done", "r.name", "r.rank")
    found = (join_keys(want, upto, [group, "tick"])
             .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
             .select(group, F.col("tick").alias("t"), "done", "name", "bin", (F.col("rank") - F.col("before") + 1).alias("nth")))
    # the nth value of the bin among the rows up to the tick
    rows = join_keys(found, x, [group, "bin"]).where(F.col("tick") <= F.col("t"))
    nth = Window.partitionBy(group, "t", "name").orderBy("by_value")
    value = (rows.withColumn("i", F.row_number().over(nth)).where(F.col("i") == F.col("nth"))
             .groupBy(group, "done").agg(*[F.max(F.when(F.col("name") == n, F.col("dur_ms"))).alias(n)
                                           for n in ("f50", "g50", "f95", "g95")]))

    def between(q, f, g):
        r = F.lit(q) * (F.col("done") - 1)
        return F.col(f) * (1 - (r - F.floor(r))) + F.col(g) * (r - F.floor(r))

    return value.select(group, "done", between(0.5, "f50", "g50").alias("p50_ms"), between(0.95, "f95", "g95").alias("p95_ms"))


def running_qps(m: DataFrame, tick_ms: int = 200, group: str = "level") -> DataFrame:
    """M8: completed so far / elapsed so far at every tick from the level's
    start to its last completion, ticks without completions included.

    Totals at the ticks with completions come from range-wise sums; the ticks
    up to the next of them repeat the total."""
    tick_us = int(tick_ms) * 1000
    start = m.groupBy(group).agg(F.min("started_us").alias("_s"))
    t = (join_keys(m, start, [group])
         .withColumn("tick", F.greatest(F.lit(1), F.ceil((F.col("ended_us") - F.col("_s")) / tick_us)).cast("long"))
         .groupBy(group, "tick").agg(F.count("*").alias("completed")))
    t = running(t, [group], ["tick"], "completed", "before", rows_out="i")
    nxt = t.select(group, (F.col("i") - 1).alias("i"), F.col("tick").alias("next"))
    t = join_keys(t, nxt, [group, "i"], "left")
    zero = F.lit(0).cast("long")
    quiet = (explode_range(t.groupBy(group).agg(F.min("tick").alias("m")), F.lit(1), F.col("m") - 1, "tick")
             .select(group, "tick", zero.alias("completed"), zero.alias("cum_completed")))
    t = explode_range(t, F.col("tick"), F.coalesce(F.col("next"), F.col("tick") + 1) - 1, "at")
    first = F.col("at") == F.col("tick")
    seen = t.select(group, F.col("at").alias("tick"), F.when(first, F.col("completed")).otherwise(F.lit(0)).alias("completed"),
                    (F.col("before") + F.col("completed")).alias("cum_completed"))
    return (seen.unionByName(quiet).withColumn("elapsed_s", F.col("tick") * (tick_ms / 1000.0))
            .withColumn("qps", F.col("cum_completed") / F.col("elapsed_s")))


def progress_steps(p: DataFrame, phase: str = "phase", steps: int = PROGRESS_STEPS) -> DataFrame:
    """Keep a progress row when its step (done*steps div total) exceeds
    every earlier step of the phase; step 0 is never kept.

    Equivalent scalable form: for every step s >= 1 the first row whose step
    is >= s; computed from per-(phase, step) minima (at most steps+1 rows per
    phase), never by scanning a phase in one task."""
    x = (p.where(F.col("total") > 0)
         .withColumn("step", F.floor(F.col("done") * steps / F.col("total")).cast("long")))
    # per (phase, step) the earliest row, whole (struct order = seq first):
    # at most steps+1 rows per phase, and the rows table is read once
    first = x.groupBy(phase, "step").agg(F.min(F.struct("seq", "done", "total", "step")).alias("_r"))
    w = Window.partitionBy(phase).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = (first.withColumn("_first", F.min("_r").over(w)).where(F.col("step") >= 1)
            .select(phase, "_first").distinct())
    return kept.select(phase, "_first.seq", "_first.done", "_first.total", "_first.step")


def stage_durations(m: DataFrame, group=("run_id", "phase")) -> DataFrame:
    """First start, last end, duration in ns and rows per stage."""
    return (m.groupBy(*group).agg(F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us"),
                                  F.count("*").alias("rows"))
            .withColumn("duration_ns", (F.col("ended_us") - F.col("started_us")) * 1000))


def levels_from_rows(spark, rows, run_id: str = "run") -> DataFrame:
    """Levels table from (concurrency, qps) pairs in list order (fixtures,
    reports of other tools)."""
    return spark.createDataFrame(
        [(run_id, i, int(c), float(q)) for i, (c, q) in enumerate(rows)],
        "run_id string, level_idx int, concurrency int, qps double")
