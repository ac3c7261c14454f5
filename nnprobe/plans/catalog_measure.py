"""Registered queries over ``events`` read as measurement rows.

level/phase = event_type, worker = user_id, seq = event_id, end = ts,
duration = value ms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nnprobe.operators import measure as M
from nnprobe.operators.ranking import join_keys, positions
from nnprobe.plans import sqlparts as S
from nnprobe.session import table

# Fixed parameters of the registered queries.
QPS_TICK_MS = 3_600_000   # events span 30 days: hourly ticks


def _m(spark, sf):
    return M.from_events(table(spark, sf, "events"))


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def q_latency_summary(spark, sf):
    m = M.with_warmup(_m(spark, sf), "phase").where(~F.col("warmup"))
    s = M.latency_summary(m)
    return s.select("run_id", "phase", "count", *[_r6(c).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")])


SQL_LATENCY_SUMMARY = f"""WITH {S.measurements_cte()},
w AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY seq) AS rn FROM m)
SELECT run_id, phase, count(*) AS count, round(avg(dur_ms), 6) AS mean_ms,
       round(quantile_cont(dur_ms, 0.5), 6) AS p50_ms, round(quantile_cont(dur_ms, 0.95), 6) AS p95_ms,
       round(quantile_cont(dur_ms, 0.99), 6) AS p99_ms
FROM w WHERE rn > {M.WARMUP} GROUP BY run_id, phase"""


def q_level_stats(spark, sf):
    lv = M.levels(_m(spark, sf))
    return lv.select("run_id", "level_idx", "level", "concurrency", "total_queries", "duration_ns",
                     _r6("qps").alias("qps"), _r6("p95_ms").alias("p95_ms"))


_SQL_LEVELS = f"""{S.measurements_cte()},
lv0 AS (SELECT run_id, level, min(seq) AS first_seq, count(DISTINCT worker)::INTEGER AS concurrency,
               count(*) AS total_queries, (max(ended_us) - min(started_us)) * 1000 AS duration_ns,
               quantile_cont(dur_ms, 0.95) AS p95_ms
        FROM m GROUP BY run_id, level),
lv AS (SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY first_seq, level) - 1)::INTEGER AS level_idx,
              level, concurrency, total_queries, duration_ns,
              CASE WHEN duration_ns > 0 THEN total_queries / (duration_ns / 1e9) ELSE 0.0 END AS qps, p95_ms
       FROM lv0)"""

SQL_LEVEL_STATS = f"""WITH {_SQL_LEVELS}
SELECT run_id, level_idx, level, concurrency, total_queries, duration_ns, round(qps, 6) AS qps,
       round(p95_ms, 6) AS p95_ms FROM lv"""


def q_peak(spark, sf):
    p = M.peak(M.levels(_m(spark, sf)))
    return p.select("run_id", _r6("peak_qps").alias("peak_qps"), "peak_level", "peak_level_idx")


_SQL_PEAK = """pk AS (
  SELECT run_id, arg_max(struct_pack(qps := qps, concurrency := concurrency, level_idx := level_idx),
                         struct_pack(qps := qps, neg := -level_idx)) AS b
  FROM lv GROUP BY run_id),
pk2 AS (SELECT run_id, CASE WHEN b.qps > 0 THEN b.qps ELSE 0.0 END AS peak_qps,
               CASE WHEN b.qps > 0 THEN b.concurrency ELSE 0 END AS peak_level,
               CASE WHEN b.qps > 0 THEN b.level_idx ELSE NULL END AS peak_level_idx FROM pk)"""

SQL_PEAK = f"""WITH {_SQL_LEVELS}, {_SQL_PEAK}
SELECT run_id, round(peak_qps, 6) AS peak_qps, peak_level::INTEGER AS peak_level,
       peak_level_idx::INTEGER AS peak_level_idx FROM pk2"""


def q_saturation(spark, sf):
    s = M.saturation(M.levels(_m(spark, sf)))
    return s.select("run_id", _r6("peak_qps").alias("peak_qps"), "peak_level", "saturated_at")


SQL_SATURATION = f"""WITH {_SQL_LEVELS}, {_SQL_PEAK},
g AS (SELECT run_id, level_idx, qps, lag(qps) OVER (PARTITION BY run_id ORDER BY level_idx) AS pq,
             lag(concurrency) OVER (PARTITION BY run_id ORDER BY level_idx) AS pc FROM lv),
s AS (SELECT run_id, arg_min(pc, level_idx) AS sat FROM g
      WHERE pq > 0 AND (qps - pq) / pq < {M.SATURATION_GAIN} GROUP BY run_id)
SELECT pk2.run_id, round(peak_qps, 6) AS peak_qps, peak_level::INTEGER AS peak_level,
       coalesce(s.sat, pk2.peak_level)::INTEGER AS saturated_at
FROM pk2 LEFT JOIN s ON s.run_id = pk2.run_id"""


def q_running_percentiles(spark, sf):
    r = M.running_percentiles(_m(spark, sf), "level")
    return r.select("level", "done", _r6("p50_ms").alias("p50_ms"), _r6("p95_ms").alias("p95_ms"))


SQL_RUNNING_PERCENTILES = f"""WITH {S.measurements_cte()},
n AS (SELECT level, dur_ms, row_number() OVER (PARTITION BY level ORDER BY seq) AS done FROM m),
t AS (SELECT level, count(*) AS q, greatest(1, count(*) // {M.TICKS}) AS every FROM m GROUP BY level),
ticks AS (SELECT DISTINCT level, d AS done FROM (
            SELECT level, unnest(list_concat(list_transform(range(0, (q - 1) // every + 1), lambda j: 1 + j * every), [q])) AS d
            FROM t))
SELECT ticks.level, ticks.done, round(quantile_cont(n.dur_ms, 0.5), 6) AS p50_ms,
       round(quantile_cont(n.dur_ms, 0.95), 6) AS p95_ms
FROM ticks JOIN n ON n.level = ticks.level AND n.done <= ticks.done
GROUP BY ticks.level, ticks.done"""


def q_running_qps(spark, sf):
    r = M.running_qps(_m(spark, sf), QPS_TICK_MS, "level")
    return r.select("level", "tick", "completed", "cum_completed", _r6("elapsed_s").alias("elapsed_s"),
                    _r6("qps").alias("qps"))


SQL_RUNNING_QPS = f"""WITH {S.measurements_cte()},
s AS (SELECT level, min(started_us) AS s0 FROM m GROUP BY level),
t AS (SELECT m.level, greatest(1, ceil((m.ended_us - s.s0) / {QPS_TICK_MS * 1000}))::BIGINT AS tick, count(*) AS completed
      FROM m JOIN s ON s.level = m.level GROUP BY 1, 2),
g AS (SELECT level, unnest(range(1, max(tick) + 1)) AS tick FROM t GROUP BY level),
c AS (SELECT g.level, g.tick, coalesce(t.completed, 0) AS completed,
             sum(coalesce(t.completed, 0)) OVER (PARTITION BY g.level ORDER BY g.tick) AS cum_completed
      FROM g LEFT JOIN t ON t.level = g.level AND t.tick = g.tick)
SELECT level, tick, completed, cum_completed::BIGINT AS cum_completed,
       round((tick * {QPS_TICK_MS / 1000.0})::DOUBLE, 6) AS elapsed_s,
       round(cum_completed / (tick * {QPS_TICK_MS / 1000.0}), 6) AS qps FROM c"""


def q_progress_steps(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("event_id").alias("seq"))
    p = positions(ev, "phase", "seq", "done")
    tot = ev.groupBy("phase").agg(F.count("*").alias("total"))
    return M.progress_steps(join_keys(p, tot, ["phase"]))


SQL_PROGRESS_STEPS = f"""WITH p AS (
  SELECT event_type AS phase, event_id AS seq,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS done,
         count(*) OVER (PARTITION BY event_type) AS total FROM events),
x AS (SELECT *, (done * {M.PROGRESS_STEPS} // total) AS step FROM p WHERE total > 0),
y AS (SELECT *, coalesce(max(step) OVER (PARTITION BY phase ORDER BY seq
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM x)
SELECT phase, seq, done::BIGINT AS done, total::BIGINT AS total, step::BIGINT AS step FROM y WHERE step > prev"""


def q_stage_durations(spark, sf):
    return M.stage_durations(_m(spark, sf)).select("run_id", "phase", "started_us", "ended_us", "rows",
                                                   "duration_ns")


SQL_STAGE_DURATIONS = f"""WITH {S.measurements_cte()}
SELECT run_id, phase, min(started_us) AS started_us, max(ended_us) AS ended_us, count(*) AS rows,
       (max(ended_us) - min(started_us)) * 1000 AS duration_ns
FROM m GROUP BY run_id, phase"""


def q_warmup_split(spark, sf):
    """M9: rows per phase kept and skipped as warm-up."""
    m = M.with_warmup(_m(spark, sf), "phase")
    return m.groupBy("phase").agg(F.count_if(F.col("warmup")).alias("warmup_rows"),
                                  F.count_if(~F.col("warmup")).alias("timed_rows"),
                                  F.max(F.when(F.col("warmup"), F.col("seq"))).alias("last_warmup_seq"))


SQL_WARMUP_SPLIT = f"""WITH {S.measurements_cte()},
w AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY seq) <= {M.WARMUP} AS warmup FROM m)
SELECT phase, count(*) FILTER (WHERE warmup) AS warmup_rows, count(*) FILTER (WHERE NOT warmup) AS timed_rows,
       max(CASE WHEN warmup THEN seq END) AS last_warmup_seq FROM w GROUP BY phase"""


def q_quantized_durations(spark, sf):
    """M10 over nanosecond durations derived from the rows' values."""
    ev = table(spark, sf, "events")
    ns = (F.col("value") * 1_000_000).cast("long")
    return ev.select(F.col("event_id").alias("seq"), ns.alias("dur_ns"),
                     _r6(M.quantize_ms(ns)).alias("dur_ms"))


SQL_QUANTIZED_DURATIONS = """SELECT event_id AS seq, CAST(trunc(value * 1000000) AS BIGINT) AS dur_ns,
       round(floor(CAST(trunc(value * 1000000) AS BIGINT) / 1000) / 1000.0, 6) AS dur_ms FROM events"""


def entries():
    return {
        "latency_summary": (q_latency_summary, SQL_LATENCY_SUMMARY),
        "level_stats": (q_level_stats, SQL_LEVEL_STATS),
        "peak": (q_peak, SQL_PEAK),
        "saturation": (q_saturation, SQL_SATURATION),
        "running_percentiles": (q_running_percentiles, SQL_RUNNING_PERCENTILES),
        "running_qps": (q_running_qps, SQL_RUNNING_QPS),
        "progress_steps": (q_progress_steps, SQL_PROGRESS_STEPS),
        "stage_durations": (q_stage_durations, SQL_STAGE_DURATIONS),
        "warmup_split": (q_warmup_split, SQL_WARMUP_SPLIT),
        "quantized_durations": (q_quantized_durations, SQL_QUANTIZED_DURATIONS),
    }
