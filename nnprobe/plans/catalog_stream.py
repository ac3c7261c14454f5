"""Registered streaming queries (T1-T4): the stream runs over every file
available, and the final table must equal the batch statistic."""

from __future__ import annotations

from pyspark.sql import functions as F

from nnprobe.operators import measure as M
from nnprobe.plans import sqlparts as S
from nnprobe.session import scratch_path, table
from nnprobe.streaming import live, stateful

# Fixed parameters: events span 30 days.
WINDOW = "1 day"
WATERMARK = "1 hour"
DAY_US = 86_400_000_000
QPS_SCHEMA = "level string, window_start_us long, window_end_us long, completed long"
WATERMARK_US = 3_600_000_000


def _stream(spark, sf):
    return live.measurement_stream(live.event_stream(spark, sf, "events.parquet"))


def _r6(c):
    return F.round(F.col(c), 6)


def q_live_latency(spark, sf):
    out, _ = live.run_to_table(live.live_latency(_stream(spark, sf)), "complete", "live-latency")
    r = live.latency_of(live.read_result(spark, out, live.LATENCY_SCHEMA, "complete"))
    return r.select("run_id", "phase", "count", _r6("p50_ms").alias("p50_ms"), _r6("p95_ms").alias("p95_ms"))


SQL_LIVE_LATENCY = f"""WITH {S.measurements_cte()}
SELECT run_id, phase, count(*) AS count, round(quantile_cont(dur_ms, 0.5), 6) AS p50_ms,
       round(quantile_cont(dur_ms, 0.95), 6) AS p95_ms FROM m GROUP BY run_id, phase"""


def q_live_qps_closed_windows(spark, sf):
    out, _ = live.run_to_table(live.live_qps(_stream(spark, sf), WINDOW, WATERMARK), "append", "live-qps")
    return live.read_result(spark, out, "level string, window_start_us long, window_end_us long, completed long")


SQL_LIVE_QPS_CLOSED_WINDOWS = f"""WITH {S.measurements_cte()},
mx AS (SELECT max(ended_us) AS mx FROM m),
w AS (SELECT level, (ended_us // {DAY_US}) * {DAY_US} AS ws, count(*) AS completed FROM m GROUP BY 1, 2)
SELECT level, ws AS window_start_us, ws + {DAY_US} AS window_end_us, completed
FROM w, mx WHERE ws + {DAY_US} <= (mx.mx // 1000) * 1000 - {WATERMARK_US}"""


def q_live_cumulative_qps(spark, sf):
    out, _ = live.run_to_table(live.live_qps(_stream(spark, sf), WINDOW, WATERMARK), "append", "live-cum")
    closed = live.read_result(spark, out, QPS_SCHEMA)
    return live.cumulative_qps(closed).select("level", "window_end_us", "completed", "cum_completed", _r6("qps").alias("qps"))


SQL_LIVE_CUMULATIVE_QPS = f"""WITH {S.measurements_cte()},
mx AS (SELECT max(ended_us) AS mx FROM m),
w AS (SELECT level, (ended_us // {DAY_US}) * {DAY_US} AS ws, count(*) AS completed FROM m GROUP BY 1, 2),
c AS (SELECT level, ws, completed FROM w, mx WHERE ws + {DAY_US} <= (mx.mx // 1000) * 1000 - {WATERMARK_US}),
g AS (SELECT level, min(ws) AS s, unnest(range(min(ws), max(ws) + 1, {DAY_US})) AS ws FROM c GROUP BY level),
h AS (SELECT g.level, g.s, g.ws, coalesce(c.completed, 0) AS completed FROM g LEFT JOIN c ON c.level = g.level AND c.ws = g.ws),
k AS (SELECT *, sum(completed) OVER (PARTITION BY level ORDER BY ws)::BIGINT AS cum_completed FROM h)
SELECT level, ws + {DAY_US} AS window_end_us, completed, cum_completed, round(cum_completed / ((ws + {DAY_US} - s) / 1e6), 6) AS qps FROM k"""


def _late_source(spark, sf):
    """The events as files in the order newest third, one row of each type again, oldest two thirds."""
    ev = table(spark, sf, "events").select(*[f.strip().split(" ")[0] for f in live.EVENTS_SCHEMA.split(",")])
    cut = F.lit(ev.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 10 DAYS")
    root = scratch_path(spark, "late")
    new = ev.where(F.col("ts") > cut)
    again = new.groupBy("event_type").agg(F.max_by(F.struct(*ev.columns), "event_id").alias("r")).select("r.*")
    for part, df in (("a", new), ("b", again), ("c", ev.where(F.col("ts") <= cut))):
        df.coalesce(1).write.parquet(f"{root}/{part}")
    return (spark.readStream.schema(live.EVENTS_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
            .parquet(root))


def q_live_qps_late_rows(spark, sf):
    """T5: the older rows come two batches after the newest and are dropped; closed windows hold the newer rows only."""
    m = live.measurement_stream(_late_source(spark, sf))
    out, _ = live.run_to_table(live.live_qps(m, WINDOW, WATERMARK), "append", "late-qps")
    return live.read_result(spark, out, QPS_SCHEMA)


SQL_LIVE_QPS_LATE_ROWS = f"""WITH {S.measurements_cte()},
mx AS (SELECT max(ended_us) AS mx FROM m),
new AS (SELECT m.* FROM m, mx WHERE ended_us > mx.mx - 10 * {DAY_US}),
rows2 AS (SELECT level, ended_us FROM new UNION ALL
          SELECT level, ended_us FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY seq DESC) AS r FROM new) WHERE r = 1),
w AS (SELECT level, (ended_us // {DAY_US}) * {DAY_US} AS ws, count(*) AS completed FROM rows2 GROUP BY 1, 2)
SELECT level, ws AS window_start_us, ws + {DAY_US} AS window_end_us, completed
FROM w, mx WHERE ws + {DAY_US} <= (mx.mx // 1000) * 1000 - {WATERMARK_US}"""


def q_live_latency_sketch(spark, sf):
    """T1 by sketch: count, and whether state and ranks stay within their bounds (the rank of the batch's rows)."""
    out, _ = live.run_to_table(live.live_latency_sketch(_stream(spark, sf)), "complete", "live-sketch")
    state = live.read_result(spark, out, live.SKETCH_SCHEMA, "complete")
    got = live.sketched_latency(state).join(state.select("run_id", "phase", F.octet_length("sketch").alias("size")), ["run_id", "phase"])
    m = M.from_events(table(spark, sf, "events")).where(F.col("dur_ms").isNotNull())
    off = lambda p, n: F.greatest(F.avg((F.col("dur_ms") < F.col(n)).cast("double")) - p,
                                  p - F.avg((F.col("dur_ms") <= F.col(n)).cast("double"))) <= live.SKETCH_ERROR
    return m.join(F.broadcast(got), ["run_id", "phase"]).groupBy("run_id", "phase").agg(
        F.max("count").alias("count"), off(0.5, "p50_ms").alias("p50_in_bound"), off(0.95, "p95_ms").alias("p95_in_bound"),
        (F.max("size") <= 16 * live.SKETCH_K * 8).alias("state_in_bound"))


SQL_LIVE_LATENCY_SKETCH = f"""WITH {S.measurements_cte()}
SELECT run_id, phase, count(dur_ms) AS count, true AS p50_in_bound, true AS p95_in_bound, true AS state_in_bound FROM m GROUP BY run_id, phase"""


def q_live_cumulative_stream(spark, sf):
    """T2 added up inside the stream, by a second stateful operator behind the windows."""
    closed = live.live_qps(_stream(spark, sf), WINDOW, WATERMARK)
    with stateful.with_state_store(spark):
        out, _ = live.run_to_table(stateful.cumulative_stream(closed), "append", "live-cum-stream")
    r = live.read_result(spark, out, stateful.CUMULATIVE_SCHEMA)
    return r.select("level", "window_end_us", "completed", "cum_completed", _r6("qps").alias("qps"))


def q_live_qps_reconciled(spark, sf):
    """T5: the rows that come late are counted, kept, and their windows corrected."""
    m = live.measurement_stream(_late_source(spark, sf))
    windows, late = live.reconciled_qps(spark, m, DAY_US, WATERMARK_US)
    kept = late.groupBy("level", "window_start_us").agg(F.count("*").alias("kept"))
    return windows.join(kept, ["level", "window_start_us"], "left").select(
        "level", "window_start_us", "window_end_us", "completed", "late", F.coalesce("kept", F.lit(0).cast("long")).alias("late_rows_kept"))


SQL_LIVE_QPS_RECONCILED = f"""WITH {S.measurements_cte()},
mx AS (SELECT max(ended_us) AS mx FROM m),
r AS (SELECT level, ended_us, 0 AS batch FROM m, mx WHERE ended_us > mx - 10 * {DAY_US}
      UNION ALL SELECT level, ended_us, 1 FROM (SELECT level, ended_us, row_number() OVER (PARTITION BY level ORDER BY seq DESC) AS r
        FROM m, mx WHERE ended_us > mx - 10 * {DAY_US}) WHERE r = 1
      UNION ALL SELECT level, ended_us, 2 FROM m, mx WHERE ended_us <= mx - 10 * {DAY_US}),
w AS (SELECT level, (ended_us // {DAY_US}) * {DAY_US} AS ws, batch FROM r)
SELECT level, ws AS window_start_us, ws + {DAY_US} AS window_end_us, count(*) AS completed,
       count(*) FILTER (batch > 0 AND ws + {DAY_US} <= mx - {WATERMARK_US}) AS late,
       count(*) FILTER (batch > 0 AND ws + {DAY_US} <= mx - {WATERMARK_US}) AS late_rows_kept FROM w, mx GROUP BY level, ws"""


def _progress_events(ev):
    """The events as progress events of 20 phases (user modulo 20)."""
    n = F.col("event_id") % 10
    kind = F.when(n == 0, "start").when(n == 9, "end").when(n == 5, "warn").otherwise("progress")
    return ev.select((F.col("user_id") % 20).alias("phase"), F.col("event_id").alias("seq"), kind.alias("kind"),
                     F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("text"),
                     (F.col("event_id") % 97).alias("done"), (F.col("event_id") % 3 * 97).alias("total"))


def q_phase_machine(spark, sf):
    """T3 as a state machine over files of the events; the latest row of a phase is its state."""
    root = scratch_path(spark, "phase-files")
    (_progress_events(table(spark, sf, "events")).repartition(4, "seq").write.parquet(root))
    rows = (spark.readStream.schema("phase long, seq long, kind string, text string, done long, total long")
            .option("maxFilesPerTrigger", 1).parquet(root))
    out, _ = live.run_to_table(stateful.phase_machine(rows), "update", "phase-machine")
    changes = live.read_result(spark, out, stateful.PHASE_SCHEMA + ", epoch long", "update")
    last = changes.groupBy("phase").agg(F.max_by(F.struct(*changes.columns), "epoch").alias("r")).select("r.*")
    return last.select("phase", "status", "note", "summary", F.round("fraction", 6).alias("fraction"), "warnings")


def q_phase_fold(spark, sf):
    """The events as progress events of 20 phases (user modulo 20)."""
    ev = live.event_stream(spark, sf, "events.parquet")
    rows = _progress_events(ev)
    out, _ = live.run_to_table(live.phase_fold(rows), "complete", "phase-fold")
    r = live.read_result(spark, out, "phase long, status string, note string, summary string, fraction double, warnings long", "complete")
    return r.withColumn("fraction", F.round("fraction", 6))


SQL_PHASE_FOLD = """WITH e AS (SELECT user_id % 20 AS phase, event_id AS seq, event_id % 10 AS n, event_type || ' ' || event_id::VARCHAR AS text,
  event_id % 97 AS done, event_id % 3 * 97 AS total FROM events)
SELECT phase, CASE WHEN max(seq) FILTER (WHERE n = 9) > coalesce(max(seq) FILTER (WHERE n = 0), -1) THEN 'done'
    WHEN max(seq) FILTER (WHERE n = 0) IS NOT NULL THEN 'active' ELSE 'pending' END AS status,
  arg_max(text, seq) FILTER (WHERE n = 0) AS note, arg_max(text, seq) FILTER (WHERE n = 9) AS summary,
  round(coalesce(arg_max(done / total, seq) FILTER (WHERE n NOT IN (0, 5, 9) AND total > 0), 0.0), 6) AS fraction,
  count(*) FILTER (WHERE n = 5) AS warnings FROM e GROUP BY phase"""


def q_phase_status(spark, sf):
    out, _ = live.run_to_table(live.phase_status(_stream(spark, sf)), "complete", "phase-status")
    return live.read_result(spark, out, "run_id string, phase string, first_start_us long, last_end_us long, "
                                        "rows long, last_seq long, last_worker long, last_dur_ms double",
                            "complete")


SQL_PHASE_STATUS = f"""WITH {S.measurements_cte()}
SELECT run_id, phase, min(started_us) AS first_start_us, max(ended_us) AS last_end_us, count(*) AS rows,
       max(seq) AS last_seq, arg_max(worker, seq) AS last_worker, arg_max(dur_ms, seq) AS last_dur_ms
FROM m GROUP BY run_id, phase"""


def q_running_peak(spark, sf):
    r = live.running_peak(spark, _stream(spark, sf), "running-peak")
    return r.select("run_id", "level", "total_queries", "duration_ns", _r6("qps").alias("qps"), "leading")


SQL_RUNNING_PEAK = f"""WITH {S.measurements_cte()},
lv AS (SELECT run_id, level, min(seq) AS first_seq, count(*) AS total_queries,
              (max(ended_us) - min(started_us)) * 1000 AS duration_ns FROM m GROUP BY run_id, level),
q AS (SELECT *, CASE WHEN duration_ns > 0 THEN total_queries / (duration_ns / 1e9) ELSE 0.0 END AS qps,
             row_number() OVER (PARTITION BY run_id ORDER BY first_seq, level) - 1 AS level_idx FROM lv),
pk AS (SELECT run_id, arg_max(level_idx, struct_pack(qps := qps, neg := -level_idx)) AS best,
              max(qps) AS mq FROM q GROUP BY run_id)
SELECT q.run_id, q.level, q.total_queries, q.duration_ns, round(q.qps, 6) AS qps,
       coalesce(pk.mq > 0 AND q.level_idx = pk.best, false) AS leading
FROM q JOIN pk ON pk.run_id = q.run_id"""


def entries():
    return {
        "live_latency": (q_live_latency, SQL_LIVE_LATENCY),
        "live_qps_closed_windows": (q_live_qps_closed_windows, SQL_LIVE_QPS_CLOSED_WINDOWS),
        "live_cumulative_qps": (q_live_cumulative_qps, SQL_LIVE_CUMULATIVE_QPS),
        "live_qps_late_rows": (q_live_qps_late_rows, SQL_LIVE_QPS_LATE_ROWS),
        "live_latency_sketch": (q_live_latency_sketch, SQL_LIVE_LATENCY_SKETCH),
        "live_cumulative_stream": (q_live_cumulative_stream, SQL_LIVE_CUMULATIVE_QPS),
        "live_qps_reconciled": (q_live_qps_reconciled, SQL_LIVE_QPS_RECONCILED),
        "phase_machine": (q_phase_machine, SQL_PHASE_FOLD),
        "phase_fold": (q_phase_fold, SQL_PHASE_FOLD),
        "phase_status": (q_phase_status, SQL_PHASE_STATUS),
        "running_peak": (q_running_peak, SQL_RUNNING_PEAK),
    }
