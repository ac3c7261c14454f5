import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from nnprobe.operators import ivf, knn, recall, sampling
from nnprobe.plans.catalog_vectors import base
from nnprobe.plans.evaluation import EvalConfig, evaluate


def test_full_probe_equals_exact(spark):
    b = base(spark, SF001)
    q = sampling.sample_queries(b, 20)
    c = ivf.train_sample(b, 8, "cosine")
    idx = ivf.build_index(b, c, "cosine")
    a = rows(ivf.search(spark, idx, q, 10, 8), "qid", "rank")
    e = rows(knn.exact_knn(b, q, 10, "cosine"), "qid", "rank")
    assert a == e


def test_shortcut_equals_search_and_monotone(spark):
    b = base(spark, SF001)
    cfg = EvalConfig(metric="l2", k=10, queries=25, lists=8, efforts=(1, 2, 4, 8))
    parts = evaluate(b, cfg)
    pts = {r.effort: r.recall for r in parts.points.collect()}
    vals = [pts[e] for e in (1, 2, 4, 8)]
    assert vals == sorted(vals) and vals[-1] == 1.0
    idx = ivf.build_index(b, parts.centroids, "l2")
    for e in (1, 2, 4):
        ann = ivf.search(spark, idx, parts.queries, 10, e)
        per = recall.per_query(ann, parts.truth, parts.queries)
        real = per.agg(F.avg("recall")).first()[0]
        assert abs(real - pts[e]) < 1e-12


def test_cost_full_probe_is_table(spark):
    b = base(spark, SF001)
    parts = evaluate(b, EvalConfig(queries=10, lists=8, efforts=(8, 20)))
    assert {r.scanned for r in parts.cost.collect()} == {500}


def test_kmeans_trainer(spark):
    b = base(spark, SF001)
    parts = evaluate(b, EvalConfig(metric="l2", queries=10, lists=4, efforts=(1, 4), trainer="kmeans"))
    pts = {r.effort: r.recall for r in parts.points.collect()}
    assert pts[4] == 1.0 and 0 <= pts[1] <= 1


def test_recall_fixtures(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")],
                                  "qid int, id string")
    ann = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x"), (2, "a"), (2, "b"), (3, "a")], "qid int, id string")
    qs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid int")
    per = {r.qid: r.recall for r in recall.per_query(ann, truth, qs).collect()}
    assert per == {1: 2 / 3, 2: 1.0, 3: 1 / 3, 4: 0.0}
    m = recall.mean_recall(recall.per_query(ann, truth, qs.where("qid in (2, 4)"))).first()
    assert m.recall == 0.5


def test_default_point(spark):
    def pick(efforts, d):
        pts = spark.createDataFrame([(i, e, float(i)) for i, e in enumerate(efforts)],
                                    "sweep_idx int, effort int, recall double")
        return recall.default_point(pts, d).first().sweep_idx
    assert pick([40, 100, 200], 100) == 1
    assert pick([40, 100, 200], 64) == 0
    assert pick([40, 100, 200], 0) == 0
    assert pick([40, 100, 100], 100) == 2


def test_search_in_query_slices(spark, monkeypatch):
    b = base(spark, SF001)
    q = sampling.sample_queries(b, 20)
    c = ivf.train_sample(b, 8, "cosine")
    idx = ivf.build_index(b, c, "cosine")
    want = rows(ivf.search(spark, idx, q, 10, 3), "qid", "rank")
    monkeypatch.setattr(knn, "MAX_QUERY_BYTES", (64 * 4 + 24) * 6)     # 6 queries and their probes per slice
    assert len(knn.query_chunks(q, extra=24)) == 4
    assert rows(ivf.search(spark, idx, q, 10, 3), "qid", "rank") == want


def test_list_wise_search_equals_broadcast(spark, monkeypatch):
    b = base(spark, SF001, scaled=True)
    odd = spark.createDataFrame([(9001, None), (9002, [1.0, 2.0]), (9003, [float("nan")] * 64)], "id long, embedding array<float>")
    q = sampling.sample_queries(b, 60)
    for metric, nprobe in (("cosine", 3), ("l2", 8), ("ip", 1)):
        idx = ivf.build_index(b.unionByName(odd), ivf.train_sample(b, 8, metric), metric)
        probes = sorted(rows(ivf.probe_ranks(q, idx.centroids, metric, depth=nprobe)))
        assert sorted(rows(ivf.probe_table(q.drop("pos"), idx.centroids, metric, nprobe))) == probes
        want = rows(ivf.search(spark, idx, q, 10, nprobe, strategy="broadcast"), "qid", "rank")
        assert rows(ivf.search(spark, idx, q, 10, nprobe, strategy="lists"), "qid", "rank") == want
        # hot lists: many blocks of rows and of queries
        dealt = ivf.list_scan(spark, idx, q, 10, nprobe, block_rows=9, block_queries=4).where("id IS NOT NULL")
        assert rows(knn.rank_topk(dealt, 10), "qid", "rank") == want
        # the same rows are compared
        sums = [{r.qid: r.n for r in scan.where("id IS NULL").groupBy("qid").agg(F.sum("compared").alias("n")).collect()}
                for scan in (ivf.probe_scan(spark, idx, q, 10, nprobe), ivf.list_scan(spark, idx, q, 10, nprobe, block_rows=9, block_queries=4))]
        assert sums[0] == sums[1]
    # the lists' figures by shuffle
    with monkeypatch.context() as m:
        m.setattr(ivf, "MAX_BROADCAST_LISTS", 0)
        assert rows(ivf.search(spark, idx, q, 10, nprobe, strategy="lists"), "qid", "rank") == want
    # the choice follows the size of the query set; the index is read once then
    monkeypatch.setattr(knn, "MAX_QUERY_BYTES", 2000)
    assert rows(ivf.search(spark, idx, q, 10, 1), "qid", "rank") == want
    plan = ivf.list_scan(spark, idx, q, 10, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[id#\d+L,v#", plan)) == 1
    with pytest.raises(ValueError):
        ivf.search(spark, idx, odd.selectExpr("id AS qid", "embedding AS qv"), 5, 1, strategy="lists")


def test_query_sets_without_positions_are_sliced(spark):
    q = sampling.sample_queries(base(spark, SF001), 40)
    parts = knn.query_chunks(q.drop("pos"), max_bytes=10 * 64 * 4)
    assert len(parts) > 1 and sum(p.count() for p in parts) == 40


def test_gate(spark):
    q = spark.createDataFrame([(0, 1, [1.0])], "pos int, qid long, qv array<float>")
    lk = spark.createDataFrame([("ivfflat",), ("none",)], "kind string")
    got = {r.kind: (r.run, r.warning) for r in recall.gate(lk, q).collect()}
    assert got["ivfflat"] == (True, None) and got["none"][0] is False and got["none"][1] == recall.GATE_WARNING
    assert recall.gate(lk.where("kind = 'ivfflat'"), q.where("false")).first().run is False


def test_sweep_timings(spark):
    m = spark.createDataFrame([(0, 40, 0, 1_000_000, 1.0), (0, 40, 0, 2_000_000, 2.0), (1, 100, 0, 1_000_000, 5.0)],
                              "sweep_idx int, effort int, started_us long, ended_us long, dur_ms double")
    got = {r.effort: (round(r.p95_ms, 6), r.queries, r.qps) for r in recall.sweep_timings(m).collect()}
    assert got == {40: (1.95, 2, 1.0), 100: (5.0, 1, 1.0)}


def test_read_vectors(spark):
    from nnprobe.sources.vectors import read_vectors
    df = read_vectors(spark, f"{SF001}/embeddings.parquet", "vec_id", "embedding")
    assert df.columns == ["id", "embedding"] and df.count() == 500


def test_search_reads_only_probed_lists(spark):
    b = base(spark, SF001)
    q = sampling.sample_queries(b, 1)
    c = ivf.train_sample(b, 8, "l2")
    idx = ivf.build_index(b, c, "l2")
    res = ivf.search(spark, idx, q, 5, 1)
    plan = spark._jvm.PythonSQLUtils.explainString(res._jdf.queryExecution(), "simple")
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
    assert 1 <= res.count() <= 5


def test_search_compares_only_probed_lists(spark):
    """The kernel's own counter equals the cost model: rows compared fall with the effort."""
    b = base(spark, SF001)
    parts = evaluate(b, EvalConfig(queries=20, lists=8, efforts=(1, 2, 8)))
    idx = ivf.build_index(b, parts.centroids, "cosine")
    cost = {}
    for r in parts.cost.collect():
        cost[r.effort] = cost.get(r.effort, 0) + r.scanned
    for effort in (1, 2, 8):
        scan = ivf.probe_scan(spark, idx, parts.queries, 5, effort, exclude_self=False)
        assert scan.where("id is null").agg(F.sum("compared")).first()[0] == cost[effort]
    assert cost[1] < cost[2] < cost[8] == 20 * 500


def test_assign_beyond_broadcast_bound(spark, monkeypatch):
    b = base(spark, SF001)
    c = ivf.train_sample(b, 10, "cosine")
    want = rows(ivf.assign(b, c, "cosine"), "id")
    monkeypatch.setattr(ivf, "MAX_CENTROID_BYTES", 64 * 4 * 3)     # 3 centroids per slice
    assert len(ivf.centroid_slices(c)) == 4
    got = rows(ivf.assign(b, c, "cosine"), "id")
    assert got == want
    carried = ivf.assign(b, c, "cosine", carry=True).select("id", "list_id", "v")
    assert carried.count() == 500


def test_assign_slices_keep_repeated_ids(spark, monkeypatch):
    b = base(spark, SF001)
    twice = b.unionAll(b.select((F.col("id") % 250).alias("id"), "embedding"))
    c = ivf.train_sample(b, 10, "cosine")
    want = rows(ivf.assign(twice, c, "cosine"), "id", "list_id", "list_distance")
    monkeypatch.setattr(ivf, "MAX_CENTROID_BYTES", 64 * 4 * 3)
    got = rows(ivf.assign(twice, c, "cosine"), "id", "list_id", "list_distance")
    assert len(got) == 1000 and got == want
    plan = spark._jvm.PythonSQLUtils.explainString(ivf.assign(twice, c, "cosine", carry=True)._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Join" not in plan


def test_kmeans_trains_on_all_rows(spark):
    """A far cluster of few rows gets a centroid: no row is left out of training."""
    import random
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 0.1), rng.gauss(0, 0.1)]) for i in range(3000)] + [(9000 + i, [50.0 + i, 50.0]) for i in range(3)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    c = ivf.train_kmeans(df, 2, "l2")
    far = max(r.c[0] for r in c.collect())
    assert abs(far - 51.0) < 1e-3


def test_open_index_from_a_manifest(spark):
    from nnprobe.operators import profile
    b = base(spark, SF001)
    q = sampling.sample_queries(b, 10)
    idx = ivf.build_index(b, ivf.train_sample(b, 8, "l2"), "l2")
    found = profile.index_lookup(idx.manifest(spark, "t", "embedding"), "t", "embedding").first()
    again = ivf.open_index(spark, found)
    assert rows(ivf.search(spark, again, q, 5, 3), "qid", "rank") == rows(ivf.search(spark, idx, q, 5, 3), "qid", "rank")
    none = profile.index_lookup(idx.manifest(spark, "t", "embedding"), "t", "other").first()
    try:
        ivf.open_index(spark, none)
        raise AssertionError("opened nothing")
    except ValueError:
        pass


def test_default_lists_follow_the_table(spark):
    b = base(spark, SF001)
    parts = evaluate(b, EvalConfig(queries=5, efforts=(1, 22)))
    assert parts.centroids.count() == ivf.default_lists(500) == 22


def test_timed_points(spark):
    pts = spark.createDataFrame([(0, 40, 0.5), (1, 100, 0.9)], "sweep_idx int, effort int, recall double")
    m = spark.createDataFrame([(0, 40, 0, 2_000_000, 1.0), (0, 40, 0, 2_000_000, 3.0)],
                              "sweep_idx int, effort int, started_us long, ended_us long, dur_ms double")
    got = rows(recall.timed_points(pts, recall.sweep_timings(m)).select("sweep_idx", "recall", "p95_ms", "qps"), "sweep_idx")
    assert [(a, b, c and round(c, 9), d) for a, b, c, d in got] == [(0, 0.5, 2.9, 1.0), (1, 0.9, None, None)]


def test_recall_sample_of_the_run(spark):
    b = base(spark, SF001)
    parts = evaluate(b, EvalConfig(queries=12, recall_sample=5, lists=8, efforts=(8,)))
    assert parts.queries.count() == 5 and parts.points.first().recall == 1.0
    want = {r.qid for r in sampling.sample_queries(b, 12).where("pos < 5").collect()}
    assert {r.qid for r in parts.queries.collect()} == want


def test_ragged_tables_are_refused(spark):
    import pytest
    from nnprobe.operators import profile
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, embedding array<float>")
    with pytest.raises(ValueError):
        profile.check_dimension(profile.profile(df).first())
    assert profile.check_dimension(profile.profile(df.where("id <> 2")).first()) == 2


def test_lloyd_steps_do_not_pile_up(spark):
    """The planner's size estimate of the centroids is no larger after three steps than after one."""
    import random
    from nnprobe.operators.kmeans import lloyd
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(400)], "id long, embedding array<float>")
    start = ivf.train_sample(df, 6, "l2")

    def size(steps):
        plan = lloyd(df, start, ivf.assign, "l2", max_iter=steps)._jdf.queryExecution().optimizedPlan()
        return int(str(plan.stats().sizeInBytes()))

    assert size(3) < 10 * size(1)


def test_block_kernel_scratch_is_bounded():
    """A full block of queries holds the same memory for few rows as for many, and little of it."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from nnprobe.operators import kernel
    rng, dim = np.random.default_rng(1), 64

    def batch(n, is_row):
        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(rng.normal(size=n * dim).astype(np.float32)))
        zero = np.zeros(n, np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(zero),) * 3, pa.array(np.full(n, is_row)), pa.array(np.arange(n)), v],
                                          names=["list_id", "r", "q", "is_row", "id", "v"])

    def peak(batches):
        tracemalloc.start()
        for _ in kernel.topk_per_block("cosine", 10, True, dim)([batch(ivf.BLOCK_QUERIES, False)] + [batch(4096, True)] * batches):
            pass
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top / 1e6

    few, many = peak(1), peak(4)
    assert many < 150 and many < 1.5 * few
