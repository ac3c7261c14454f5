import os

from pyspark.sql import functions as F

from conftest import SF001
from nnprobe.operators import measure as M
from nnprobe.session import scratch_path, table
from nnprobe.streaming import live


def test_live_latency_equals_batch(spark):
    s = live.measurement_stream(live.event_stream(spark, SF001, "events.parquet"))
    out, _ = live.run_to_table(live.live_latency(s), "complete", "t-lat")
    res = live.latency_of(live.read_result(spark, out, live.LATENCY_SCHEMA, "complete"))
    got = {r.phase: (r["count"], round(r.p50_ms, 9), round(r.p95_ms, 9)) for r in res.collect()}
    b = M.latency_summary(M.from_events(table(spark, SF001, "events")))
    want = {r.phase: (r["count"], round(r.p50_ms, 9), round(r.p95_ms, 9)) for r in b.collect()}
    assert got == want


def test_late_rows_dropped(spark):
    d = scratch_path(spark, "late-src")
    os.makedirs(d, exist_ok=True)
    ev = table(spark, SF001, "events")
    mx = ev.agg(F.max("ts")).first()[0]
    early = ev.where(F.col("ts") <= F.lit(mx) - F.expr("INTERVAL 10 DAYS"))
    late = ev.where(F.col("ts") > F.lit(mx) - F.expr("INTERVAL 10 DAYS"))
    late.write.parquet(f"{d}/a")
    late.limit(5).write.parquet(f"{d}/b")
    early.write.parquet(f"{d}/c")
    # batch 0: newest rows set the watermark; batch 1 moves it to the
    # late-event filter; batch 2 (older rows) is behind it and dropped
    src = spark.readStream.schema(live.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(d)
    out, _ = live.run_to_table(live.live_qps(live.measurement_stream(src), "1 day", "1 hour"), "append", "t-late")
    got = live.read_result(spark, out, "level string, window_start_us long, window_end_us long, completed long")
    # every row of the older batch sits in a window the watermark has passed
    cut = int(mx.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1e6) - 10 * 86_400_000_000
    starts = [r.window_start_us for r in got.collect()]
    assert starts and min(starts) >= cut - 86_400_000_000
    assert (got.agg(F.sum("completed")).first()[0] or 0) <= late.count() + 5


def test_running_peak_survives_restart(spark):
    d = scratch_path(spark, "peak-src")
    ev = table(spark, SF001, "events")
    ev.where("event_id < 400").write.parquet(f"{d}/a")
    state, ckpt = scratch_path(spark, "peak-state"), scratch_path(spark, "peak-ckpt")

    def run():
        src = spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").parquet(d)
        return live.running_peak(spark, live.measurement_stream(src), state_root=state, checkpoint=ckpt)

    first = {r.level: r.total_queries for r in run().collect()}
    assert sum(first.values()) == 400
    ev.where("event_id >= 400").write.parquet(f"{d}/b")
    second = run().collect()             # a new query object: state comes from storage
    want = {r.event_type: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert {r.level: r.total_queries for r in second} == want
    assert sum(r.leading for r in second) == 1


def test_run_to_table_goes_on(spark):
    d = scratch_path(spark, "latency-src")
    ev = table(spark, SF001, "events")

    def run(out=None, ckpt=None):
        src = spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").parquet(d)
        return live.run_to_table(live.live_latency(live.measurement_stream(src)), "complete", "t-again", out, ckpt)

    where = (None, None)
    for k in range(4):
        ev.where(F.col("event_id") % 4 == k).write.parquet(f"{d}/{k}")
        where = run(*where)
    counts = live.read_result(spark, where[0], live.LATENCY_SCHEMA, "complete")
    assert counts.agg(F.sum("n")).first()[0] == ev.count()
    assert len(live._versions(spark, where[0])) == 2


def _files(spark, ev, parts):
    d = scratch_path(spark, "parts-src")
    for k in range(parts):
        ev.where(F.col("event_id") % parts == k).coalesce(1).write.parquet(f"{d}/{k}")
    return spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(d)


def test_sketch_state_is_fixed_and_ranks_are_near(spark):
    n = 400_000
    rows = spark.range(n).selectExpr("'r' AS run_id", "'p' AS phase", "CAST(id * 7919 % 400009 AS DOUBLE) AS dur_ms")
    few = live.live_latency_sketch(rows.limit(20_000))
    many = live.live_latency_sketch(rows)
    size = [df.select(F.octet_length("sketch")).first()[0] for df in (few, many)]
    assert size[1] <= 2 * size[0] <= 16 * live.SKETCH_K * 8          # twenty times the rows
    got = live.sketched_latency(many).first()
    assert got["count"] == n
    for p, v in ((0.5, got.p50_ms), (0.95, got.p95_ms)):
        below = rows.where(F.col("dur_ms") < v).count() / n
        assert abs(below - p) <= live.SKETCH_ERROR
    empty = live.sketched_latency(live.live_latency_sketch(rows.limit(0)))
    assert empty.count() == 0


def test_late_rows_are_kept_and_windows_corrected(spark):
    day = 86_400_000_000
    ev = table(spark, SF001, "events")
    cut = F.lit(ev.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 10 DAYS")
    d = scratch_path(spark, "late-src")
    ev.where(F.col("ts") > cut).coalesce(1).write.parquet(f"{d}/a")
    root, ckpt = scratch_path(spark, "rec"), scratch_path(spark, "rec-ckpt")

    def run():
        src = spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").parquet(d)
        return live.reconciled_qps(spark, live.measurement_stream(src), day, 3_600_000_000, root=root, checkpoint=ckpt)

    windows, late = run()
    assert late.count() == 0 and windows.agg(F.sum("late")).first()[0] == 0
    ev.where(F.col("ts") <= cut).coalesce(1).write.parquet(f"{d}/b")
    windows, late = run()                    # a new query goes on where the first one ended
    batch = M.from_events(ev).groupBy("level", (F.floor(F.col("ended_us") / day) * day).alias("w")).agg(F.count("*").alias("n"))
    want = {(r.level, r.w): r.n for r in batch.collect()}
    got = {(r.level, r.window_start_us): r for r in windows.collect()}
    assert {k: r.completed for k, r in got.items()} == want
    assert late.count() == sum(r.late for r in got.values()) > 0
    assert all(r.revision == 1 for r in got.values() if r.late)
    assert set(late.columns) > {"level", "seq", "dur_ms", "window_start_us"}


def test_cumulative_stream_equals_batch_over_restarts(spark):
    from nnprobe.streaming import stateful
    ev = table(spark, SF001, "events")
    first = ev.orderBy("ts").limit(500)
    cut = first.agg(F.max("ts")).first()[0]
    d = scratch_path(spark, "cum-src")
    where = (None, None)
    with stateful.with_state_store(spark):
        for k, part in enumerate((ev.where(F.col("ts") <= F.lit(cut)), ev.where(F.col("ts") > F.lit(cut)))):
            part.coalesce(1).write.parquet(f"{d}/{k}")
            src = spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").parquet(d)
            closed = live.live_qps(live.measurement_stream(src), "1 day", "1 hour")
            where = live.run_to_table(stateful.cumulative_stream(closed), "append", "t-cum", *where)
    got = sorted(tuple(r) for r in live.read_result(spark, where[0], stateful.CUMULATIVE_SCHEMA).collect())
    src = spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").parquet(d)
    out, _ = live.run_to_table(live.live_qps(live.measurement_stream(src), "1 day", "1 hour"), "append", "t-cum-batch")
    closed = live.read_result(spark, out, "level string, window_start_us long, window_end_us long, completed long")
    want = sorted(tuple(r) for r in live.cumulative_qps(closed).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) > 50
    assert all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_phase_machine_equals_fold_and_tells_stalled_phases(spark):
    import time

    from nnprobe.plans.catalog_stream import _progress_events
    from nnprobe.streaming import stateful
    ev = _progress_events(table(spark, SF001, "events"))
    d = scratch_path(spark, "phase-src")
    for k in range(3):                       # in no order of seq
        ev.where(F.col("seq") % 3 == 2 - k).coalesce(1).write.parquet(f"{d}/{k}")
    kinds = "phase long, seq long, kind string, text string, done long, total long"
    src = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(d)
    out, _ = live.run_to_table(stateful.phase_machine(src), "update", "t-machine")
    rows = live.read_result(spark, out, stateful.PHASE_SCHEMA + ", epoch long", "update")
    last = rows.groupBy("phase").agg(F.max_by(F.struct("status", "note", "summary", "fraction", "warnings"), "epoch").alias("r")).select("phase", "r.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, live.phase_fold(ev).select(last.columns).collect()))
    # a phase that hears nothing for a while
    d, seen = scratch_path(spark, "quiet-src"), []
    spark.createDataFrame([(1, 1, "start", "a", 0, 0), (2, 2, "start", "b", 0, 0), (2, 3, "end", "b", 0, 0)], kinds).coalesce(1).write.parquet(f"{d}/0")
    src = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(d)
    q = (stateful.phase_machine(src, quiet_ms=500).writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "quiet-ckpt"))
         .foreachBatch(lambda b, _: seen.extend((r.phase, r.status) for r in b.collect())).trigger(processingTime="200 milliseconds").start())
    try:
        end = time.time() + 90
        while (1, "stalled") not in seen and time.time() < end:
            time.sleep(0.3)
        assert (1, "active") in seen and (1, "stalled") in seen and (2, "done") in seen and (2, "stalled") not in seen
    finally:
        q.stop()
