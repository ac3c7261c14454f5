"""Live statistics with Structured Streaming.

Measurement rows arrive as files; the running views are streaming
aggregations whose final state equals the batch statistics of §2.7:

* T1 live latency   - rows per (run, phase, duration), ``complete`` mode: the
  state is spread over tasks by duration, so a hot phase is no single state;
  count, p50 and p95 are read off the counts.
  ``live_latency_sketch`` holds one quantile sketch of fixed size per (run,
  phase) instead, for streams of many distinct durations.
* T2 live QPS       - completions per level and tumbling window, event-time
  watermark, ``append`` mode: only windows the watermark has closed are
  emitted; rows behind the watermark are dropped (T5).  Spark filters late
  rows against the previous micro-batch's watermark, so a row is dropped
  once a whole batch has passed since the watermark overtook it.
  ``reconciled_qps`` keeps such rows in a side table and corrects their windows.
* T3 phase status   - first/last time, rows, latest row's values per phase.
* T4 running peak   - per micro-batch merge of level totals into a state
  table in the shared folder, and the leading level so far.

Results go to parquet in the shared folder through ``foreachBatch`` (never
to a driver-memory sink); callers read them back as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nnprobe.operators import measure as M
from nnprobe.operators.ranking import explode_range, grouped_percentiles, join_keys, running
from nnprobe.session import remove_path, scratch_path

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                 "value double, props string")


def event_stream(spark: SparkSession, directory: str, pattern: str = "*.parquet",
                 schema: str = EVENTS_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Stream the files of ``directory`` whose names match ``pattern``."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(directory)


def measurement_stream(events: DataFrame) -> DataFrame:
    """Events as measurement rows with an event-time column ``ended_at``
    (TIMESTAMP: watermarks reject TIMESTAMP_NTZ)."""
    m = M.from_events(events)
    return m.withColumn("ended_at", F.timestamp_micros("ended_us"))


LATENCY_SCHEMA = "run_id string, phase string, dur_ms double, n long"


def live_latency(m: DataFrame) -> DataFrame:
    """The running counts per (run, phase, duration)."""
    return m.where(F.col("dur_ms").isNotNull()).groupBy("run_id", "phase", "dur_ms").agg(F.count("*").alias("n"))


def latency_of(counts: DataFrame) -> DataFrame:
    """Count, p50 and p95 per (run, phase) at the state of ``counts``."""
    keys = ["run_id", "phase"]
    total = counts.groupBy(*keys).agg(F.sum("n").alias("count"))
    return join_keys(total, grouped_percentiles(counts, keys, "dur_ms", (0.5, 0.95), ("p50_ms", "p95_ms"), weight="n"), keys, "left")


SKETCH_K = 4096               # of the quantile sketch; the error of a rank falls with it
SKETCH_ERROR = 0.003          # of a rank, as a share of the rows, at that k (99 % of all sketches; published bound 0.0013)
SKETCH_SCHEMA = "run_id string, phase string, count long, sketch binary"


def live_latency_sketch(m: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """T1 with bounded state: the count and one mergeable sketch per (run,
    phase), whatever the number of rows and of distinct durations."""
    return m.where(F.col("dur_ms").isNotNull()).groupBy("run_id", "phase").agg(
        F.count("*").alias("count"), F.kll_sketch_agg_double("dur_ms", k).alias("sketch"))


def sketched_latency(state: DataFrame) -> DataFrame:
    """Count, p50 and p95 per (run, phase) at a state of ``live_latency_sketch``;
    each is a duration whose rank is off by ``SKETCH_ERROR`` of the rows at most.
    ``latency_of`` and the batch statistics are exact."""
    return state.select("run_id", "phase", "count", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"))])


def live_qps(m: DataFrame, window: str, watermark: str) -> DataFrame:
    """Closed tumbling windows per level."""
    return (m.withWatermark("ended_at", watermark)
            .groupBy("level", F.window("ended_at", window).alias("w"))
            .agg(F.count("*").alias("completed"))
            .select("level", F.unix_micros(F.col("w.start")).alias("window_start_us"),
                    F.unix_micros(F.col("w.end")).alias("window_end_us"), "completed"))


def cumulative_qps(closed: DataFrame) -> DataFrame:
    """Completed so far and queries per second since the level's first
    window, at the end of every closed window (of ``live_qps``), the ones
    without completions included."""
    first = closed.groupBy("level").agg(F.min("window_start_us").alias("_s"),
                                        F.min(F.col("window_end_us") - F.col("window_start_us")).alias("_w"),
                                        F.max("window_end_us").alias("_e"))
    every = (explode_range(first, F.col("_s"), F.col("_e") - F.col("_w"), "window_start_us", F.col("_w"))
             .select("level", "_s", "window_start_us", "_w"))
    grid = (join_keys(every, closed.select("level", "window_start_us", "completed"), ["level", "window_start_us"], "left")
            .withColumn("completed", F.coalesce("completed", F.lit(0).cast("long"))))
    done = running(grid, ["level"], ["window_start_us"], "completed", "_before")
    seconds = (F.col("window_start_us") + F.col("_w") - F.col("_s")) / 1e6
    return done.select("level", (F.col("window_start_us") + F.col("_w")).alias("window_end_us"), "completed",
                       (F.col("_before") + F.col("completed")).alias("cum_completed"),
                       ((F.col("_before") + F.col("completed")) / seconds).alias("qps"))


def reconciled_qps(spark: SparkSession, source: DataFrame, window_us: int, lateness_us: int, name: str = "reconciled",
                   root: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """T5: (windows, late rows).  A window is closed once the latest completion
    of earlier batches is ``lateness_us`` past its end; rows that come for a
    closed window go to a side table and their window is corrected.

    windows: level, window_start_us, window_end_us, completed, late (rows that
    came behind the watermark), revision (batch that changed it last).  Batch e
    merges its counts into the newest version below e and writes version e, so a
    batch that runs again writes the same."""
    root = root or scratch_path(spark, f"stream-{name}")
    start = (F.floor(F.col("ended_us") / window_us) * window_us).cast("long")

    def merge(batch: DataFrame, epoch_id: int):
        session = batch.sparkSession
        prior = [v for v in _versions(session, f"{root}/windows") if v < epoch_id]
        was = session.read.parquet(f"{root}/windows/v{prior[-1]}") if prior else None
        # one value: the watermark of the batches before
        mark = was.agg(F.max("mark")).first()[0] if was is not None else None
        rows = batch.withColumn("window_start_us", start)
        late = (F.col("window_start_us") + window_us <= mark) if mark is not None else F.lit(False)
        rows = rows.withColumn("late", F.coalesce(late, F.lit(False)))
        rows.where("late").drop("late").write.mode("overwrite").parquet(f"{root}/late/v{epoch_id}")
        new = rows.groupBy("level", "window_start_us").agg(
            F.count("*").alias("completed"), F.count_if("late").alias("late"), F.max("ended_us").alias("mark"))
        new = new.select("level", "window_start_us", "completed", "late", F.lit(epoch_id).cast("long").alias("revision"),
                         (F.col("mark") - lateness_us).alias("mark"))
        both = new.unionByName(was) if was is not None else new
        both.groupBy("level", "window_start_us").agg(
            F.sum("completed").alias("completed"), F.sum("late").alias("late"), F.max("revision").alias("revision"),
            F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{root}/windows/v{epoch_id}")
        _prune(session, f"{root}/windows")

    q = (source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{name}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    kinds = "level string, window_start_us long, completed long, late long, revision long"
    windows = read_result(spark, f"{root}/windows", kinds, "complete").select(
        "level", "window_start_us", (F.col("window_start_us") + window_us).alias("window_end_us"), "completed", "late", "revision")
    side = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields) + ", window_start_us long"
    return windows, read_result(spark, f"{root}/late", side)


def phase_status(m: DataFrame) -> DataFrame:
    """Per phase the first start, last end, rows so far and the values
    of the latest row (by seq)."""
    return (m.groupBy("run_id", "phase")
            .agg(F.min("started_us").alias("first_start_us"), F.max("ended_us").alias("last_end_us"),
                 F.count("*").alias("rows"),
                 F.max_by(F.struct("seq", "worker", "dur_ms"), "seq").alias("_last"))
            .select("run_id", "phase", "first_start_us", "last_end_us", "rows",
                    F.col("_last.seq").alias("last_seq"), F.col("_last.worker").alias("last_worker"),
                    F.col("_last.dur_ms").alias("last_dur_ms")))


def phase_fold(events: DataFrame) -> DataFrame:
    """What a progress view shows per phase, folded from its events
    (phase, seq, kind in start/progress/end/warn, text, done, total): status
    (active from its start on, done at its end), the start's note, the end's
    summary, the share done at the latest progress with a total, and warnings.
    The state is one row per phase."""
    kind = F.col("kind")

    def latest(value, cond):
        return F.max_by(F.when(cond, value), F.when(cond, F.col("seq")))

    share = (kind == "progress") & (F.col("total") > 0)
    g = events.groupBy("phase").agg(
        F.max(F.when(kind == "start", F.col("seq"))).alias("_start"), F.max(F.when(kind == "end", F.col("seq"))).alias("_end"),
        latest(F.col("text"), kind == "start").alias("note"), latest(F.col("text"), kind == "end").alias("summary"),
        latest(F.col("done") / F.col("total"), share).alias("fraction"), F.count_if(kind == "warn").alias("warnings"))
    status = F.when(F.col("_end") > F.coalesce("_start", F.lit(-1)), "done").when(F.col("_start").isNotNull(), "active").otherwise("pending")
    return g.select("phase", status.alias("status"), "note", "summary", F.coalesce("fraction", F.lit(0.0)).alias("fraction"), "warnings")


def run_to_table(sdf: DataFrame, mode: str, name: str, out: str | None = None,
                 ckpt: str | None = None) -> tuple[str, str]:
    """Run a streaming query over everything available.  Every micro-batch
    is written to its own folder ``v<epoch>`` (overwrite), so a batch that
    is replayed after a failure rewrites the same folder instead of adding
    duplicates.  Read it back with ``read_result``.  In ``complete`` mode
    older folders than the last two go.  Called again with the folders it
    returned, the query goes on where it ended.
    Returns (output folder, checkpoint folder)."""
    spark = sdf.sparkSession
    out = out or scratch_path(spark, f"stream-{name}")
    ckpt = ckpt or scratch_path(spark, f"stream-{name}-ckpt")

    def sink(batch: DataFrame, epoch_id: int):
        if mode == "update":                     # a later row of a key replaces the earlier ones
            batch = batch.withColumn("epoch", F.lit(epoch_id).cast("long"))
        batch.write.mode("overwrite").parquet(f"{out}/v{epoch_id}")
        if mode == "complete":
            _prune(batch.sparkSession, out)

    q = (sdf.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return out, ckpt


def read_result(spark: SparkSession, path: str, schema: str, mode: str = "append") -> DataFrame:
    """The sink's table: all batch folders (``append``) or the newest one
    (``complete``, each batch holds the whole result); empty if none."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    pick = versions[-1:] if mode == "complete" else versions
    return spark.read.schema(schema).parquet(*[f"{path}/v{v}" for v in pick])


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Epoch ids of the committed state versions under ``root`` (any
    Hadoop-compatible file system, so the shared folder may be remote)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        n = st.getPath().getName()
        if n.startswith("v") and n[1:].isdigit() and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(n[1:]))
    return sorted(out)


def _prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    for v in _versions(spark, root)[:-keep]:
        remove_path(spark, f"{root}/v{v}")


def running_peak(spark: SparkSession, source: DataFrame, name: str = "peak",
                 state_root: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """T4: after every micro-batch the level totals are merged into a state
    table (one parquet version per epoch in the shared folder) and the
    leading level is recomputed; returns the final levels with a ``leading``
    flag.

    Epoch e merges its batch into the newest version below e and writes
    version e, so a replayed epoch (after a failure) rewrites the same
    version, and a restarted query finds its state on storage rather than in
    driver memory.  The state holds one row per level."""
    state_root = state_root or scratch_path(spark, f"stream-{name}-state")

    def merge(batch: DataFrame, epoch_id: int):
        part = batch.groupBy("run_id", "level").agg(
            F.min("seq").alias("first_seq"), F.count("*").alias("total_queries"),
            F.min("started_us").alias("start_us"), F.max("ended_us").alias("end_us"))
        prior = [v for v in _versions(batch.sparkSession, state_root) if v < epoch_id]
        if prior:
            part = part.unionByName(batch.sparkSession.read.parquet(f"{state_root}/v{prior[-1]}"))
        merged = part.groupBy("run_id", "level").agg(
            F.min("first_seq").alias("first_seq"), F.sum("total_queries").alias("total_queries"),
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
        merged.write.mode("overwrite").parquet(f"{state_root}/v{epoch_id}")
        _prune(batch.sparkSession, state_root)

    ckpt = checkpoint or scratch_path(spark, f"stream-{name}-ckpt")
    q = (source.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    versions = _versions(spark, state_root)
    if not versions:
        return spark.createDataFrame([], "run_id string, level string, total_queries long, "
                                         "duration_ns long, qps double, leading boolean")
    st = spark.read.parquet(f"{state_root}/v{versions[-1]}")
    lv = (st.withColumn("duration_ns", (F.col("end_us") - F.col("start_us")) * 1000)
          .withColumn("qps", F.when(F.col("duration_ns") > 0,
                                    F.col("total_queries") / (F.col("duration_ns") / 1e9)).otherwise(F.lit(0.0))))
    w = Window.partitionBy("run_id").orderBy("first_seq", "level")
    lv = lv.withColumn("level_idx", (F.row_number().over(w) - 1).cast("int")) \
        .withColumn("concurrency", F.lit(0))
    pk = M.peak(lv).select("run_id", "peak_level_idx")
    return (lv.join(pk, "run_id")
            .select("run_id", "level", "total_queries", "duration_ns", "qps",
                    (F.col("level_idx") == F.col("peak_level_idx")).alias("leading")))
