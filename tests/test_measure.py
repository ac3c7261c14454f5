import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from nnprobe.operators import measure as M
from nnprobe.operators.ranking import grouped_percentiles, positions
from nnprobe.session import table


def _m(spark, durs, level="L"):
    return spark.createDataFrame([("r", "p", level, 0, i, 0, 1, float(d)) for i, d in enumerate(durs)],
                                 "run_id string, phase string, level string, worker int, seq long, "
                                 "started_us long, ended_us long, dur_ms double")


@pytest.mark.parametrize("durs,want", [([1, 2, 3, 4], (2.5, 3.85, 3.97)), ([5], (5, 5, 5))])
def test_percentile_fixtures(spark, durs, want):
    r = M.latency_summary(_m(spark, durs)).first()
    assert (r.p50_ms, r.p95_ms, r.p99_ms) == pytest.approx(want)


def test_percentile_empty(spark):
    g = spark.createDataFrame([("r", "p")], "run_id string, phase string")
    m = g.join(_m(spark, [1]).drop("run_id", "phase").where("false"), F.lit(True), "left")
    r = M.latency_summary(m).first()
    assert (r["count"], r.p50_ms, r.p95_ms, r.p99_ms, r.mean_ms) == (0, 0.0, 0.0, 0.0, 0.0)


def test_quantize(spark):
    r = spark.range(1).select(M.quantize_ms(F.lit(1_234_999)).alias("x")).first()
    assert r.x == 1.234


@pytest.mark.parametrize("q,ticks", [(1000, 51), (30, 30), (99, 99)])
def test_tick_counts(spark, q, ticks):
    out = M.running_percentiles(_m(spark, range(q)), "level")
    assert out.count() == ticks
    last = out.orderBy(F.col("done").desc()).first()
    assert last.done == q and last.p50_ms == pytest.approx((q - 1) / 2)


LEVELS = [([(1, 100), (8, 500), (32, 520)], 520, 32, 8),
          ([(1, 100), (8, 90)], 100, 1, 1),
          ([(1, 100), (8, 200), (32, 400)], 400, 32, 32),
          ([(1, 0), (8, 50), (32, 200)], 200, 32, 32),
          ([(8, 100), (32, 100)], 100, 8, 8),
          ([(32, 300), (1, 100), (8, 200)], 300, 32, 32),
          ([(1, 0)], 0, 0, 0)]


@pytest.mark.parametrize("lv,pq,pl,sat", LEVELS)
def test_peak_and_saturation(spark, lv, pq, pl, sat):
    r = M.saturation(M.levels_from_rows(spark, lv)).first()
    assert (r.peak_qps, r.peak_level, r.saturated_at) == (pq, pl, sat)


def test_progress_fixture(spark):
    p = spark.createDataFrame([("x", i, d, 10) for i, d in enumerate([1, 1, 2, 1, 3])],
                              "phase string, seq long, done long, total long")

    assert [(r.seq, r.step) for r in M.progress_steps(p).orderBy("seq").collect()] == [(0, 1), (2, 2), (4, 3)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions_match_row_number(spark, reuse):
    ev = table(spark, SF001, "events").select(F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"), "event_id")
    w = Window.partitionBy("event_type").orderBy("event_id")
    want = {(r.event_type, r.event_id): r.n for r in ev.withColumn("n", F.row_number().over(w)).collect()}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        for parts in (1, 3, 16):
            got = {(r.event_type, r.event_id): r.position
                   for r in positions(ev, "event_type", "event_id", partitions=parts).collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_grouped_percentiles(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    data = [(k, float(v)) for k, n in (("a", 1000), (None, 501), ("b", 1), ("c", 0)) for v in rng.integers(0, 50, n)]
    data += [("a", None), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.x, r.y) for r in grouped_percentiles(df, ["k"], "v", (0.5, 0.95), ("x", "y")).collect()}
    for k in ("a", None, "b"):
        want = np.percentile([v for kk, v in data if kk == k and v is not None], [50, 95])
        assert got[k] == pytest.approx(tuple(want))
    assert set(got) == {"a", None, "b"}


def test_running_qps_lists_every_tick(spark):
    rows = [("r", "p", "L", 0, i, 0, e, 1.0) for i, e in enumerate([900_000, 950_000, 2_100_000])]
    m = spark.createDataFrame(rows, "run_id string, phase string, level string, worker int, seq long, started_us long, ended_us long, dur_ms double")
    got = [(r.tick, r.completed, r.cum_completed) for r in M.running_qps(m, 500).orderBy("tick").collect()]
    assert got == [(1, 0, 0), (2, 2, 2), (3, 0, 2), (4, 0, 2), (5, 1, 3)]


def test_warmup_first_50(spark):
    m = M.with_warmup(M.from_events(table(spark, SF001, "events")), "phase")
    per = m.groupBy("phase").agg(F.count_if("warmup").alias("w")).collect()
    assert all(r.w == 50 for r in per)


def test_epoch_us_ignores_session_zone(spark):
    ev = table(spark, SF001, "events").select("event_id", "ts")
    utc = {r.event_id: r.u for r in ev.select("event_id", M.epoch_us(ev, "ts").alias("u")).collect()}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = {r.event_id: r.u for r in ev.select("event_id", M.epoch_us(ev, "ts").alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == ny
    first = min(utc)
    assert utc[first] // 1_000_000 >= 1704067200          # 2024-01-01T00:00:00Z


def test_percentiles_by_brackets_equal_by_ranges(spark):
    """Both plans of one statistic, on ties, few and many values, NULL keys and values."""
    import random

    from nnprobe.operators import ranking as R
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 50), float(rnd.randrange(4)), None])) for _ in range(30_000)]
    data += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [("same", 7.0)] * 500
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    ps, names = (0.0, 0.5, 0.95, 0.99, 1.0), ("p0", "p50", "p95", "p99", "p100")
    want = {r.k: r.asDict() for r in R.percentiles_by_ranges(df, ["k"], "v", ps, names).collect()}
    for accuracy in (50, R.ACCURACY):
        got = R.percentiles_by_brackets(df, ["k"], "v", ps, names, {"n": F.count("v")}, accuracy)
        got = {r.k: r.asDict() for r in got.collect()}
        assert got["none"]["n"] == 0 and got["none"]["p50"] is None
        for k, row in want.items():
            for name in names:
                assert got[k][name] == pytest.approx(row[name], abs=1e-12), (accuracy, k, name)
    # keys of none, and an empty table
    whole = R.grouped_percentiles(df, [], "v", (0.5,), ("p50",), extra={"n": F.count("*")}).first()
    assert whole.n == len(data) and whole.p50 == pytest.approx(R.percentiles_by_ranges(df, [], "v", (0.5,), ("p50",)).first().p50)
    assert R.grouped_percentiles(df.limit(0), ["k"], "v", (0.5,), ("p50",)).count() == 0


def test_percentiles_beyond_the_brackets(spark, monkeypatch):
    from nnprobe.operators import ranking as R
    df = spark.createDataFrame([("a", float(i)) for i in range(101)], "k string, v double")
    for name, value in (("BRACKET_ROWS", 0), ("KEY_BROADCAST_ROWS", 0)):
        with monkeypatch.context() as m:
            m.setattr(R, name, value)
            assert R.percentiles_by_brackets(df, ["k"], "v", (0.5,), ("p",)) is None
            assert R.grouped_percentiles(df, ["k"], "v", (0.5,), ("p",), extra={"n": F.count("*")}).first().p == 50.0
