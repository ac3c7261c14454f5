import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from nnprobe.operators import ivf, measure as M, profile, recall
from nnprobe.plans.catalog_vectors import base
from nnprobe.session import scratch_path, table
from nnprobe.sources import reference, sinks


def _doc(spark, buckets):
    p = scratch_path(spark, "ref")
    os.makedirs(p, exist_ok=True)
    with open(f"{p}/reference.json", "w") as f:
        json.dump({"generated_at": "", "method_url": "https://example.invalid/m", "buckets": buckets}, f, indent=2)
    return f"{p}/reference.json"


def test_reference_empty_and_filled(spark):
    assert reference.read_reference(spark, _doc(spark, [])).count() == 0
    assert reference.reference_info(spark, _doc(spark, [])).first().bucket_count == 0
    b = [{"dim": 768, "rows": 1000000, "index": "hnsw", "m": 16, "ef_construction": 64, "ef_search": 100,
          "qps": 900.0, "p50_ms": 1.0, "p95_ms": 2.0, "recall": 0.99},
         {"dim": 1536, "rows": 100000, "index": "ivfflat", "ef_search": 10}]
    rows = reference.read_reference(spark, _doc(spark, b)).orderBy("bucket_pos").collect()
    assert [(r.bucket_pos, r.dim, r["index"]) for r in rows] == [(0, 768, "hnsw"), (1, 1536, "ivfflat")]
    assert rows[1].m is None


def test_stored_size(spark):
    got = profile.stored_size(table(spark, SF001, "embeddings")).first()
    assert got.table_size_bytes == os.path.getsize(f"{SF001}/embeddings.parquet") and got.files == 1


def test_measurement_sink(spark):
    p = scratch_path(spark, "meas")
    m = M.from_events(table(spark, SF001, "events"))
    sinks.write_measurements(m.withColumn("run_id", F.lit("a")), p)
    sinks.write_measurements(m.limit(10).withColumn("run_id", F.lit("b")), p)
    back = spark.read.parquet(p)
    assert {r.run_id: r["count"] for r in back.groupBy("run_id").count().collect()} == {"a": 1000, "b": 10}
    assert sorted(os.listdir(p))[-2:] == ["run_id=a", "run_id=b"]
    # a run that is written again is there once, and the others stay
    sinks.write_measurements(m.withColumn("run_id", F.lit("a")), p)
    sinks.write_measurements(m.limit(7).withColumn("run_id", F.lit(None).cast("string")), p)
    back = sinks.read_measurements(spark, p)
    assert {r.run_id: r["count"] for r in back.groupBy("run_id").count().collect()} == {"a": 1000, "b": 10, None: 7}
    runs = {r.run_id: r for r in sinks.measurement_runs(spark, p).collect()}
    assert {k: r.rows for k, r in runs.items()} == {"a": 1000, "b": 10, None: 7}
    assert runs["a"].started_us == m.agg(F.min("started_us")).first()[0]
    fails = m.withColumn("run_id", F.lit("a")).withColumn("dur_ms", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_measurements(fails, p)
    assert sinks.read_measurements(spark, p).where("run_id = 'a'").count() == 1000


def test_a_failed_write_leaves_the_old_table(spark):
    from nnprobe.sources import synthetic as S
    path = scratch_path(spark, "ds")
    with pytest.raises(FileNotFoundError):
        S.read_dataset(spark, path)
    good = S.unit_vectors(spark, 40, 4)
    S.write_dataset(good, path, partitions=2)
    bad = good.withColumn("id", F.raise_error(F.lit("broken")).cast("long"))
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            S.write_dataset(bad, path)
        assert S.read_dataset(spark, path).count() == 40
    old = S.read_dataset(spark, path)
    S.write_dataset(S.unit_vectors(spark, 50, 4), path)
    assert S.read_dataset(spark, path).count() == 50 and old.count() == 40      # who reads the version before may finish
    S.write_dataset(S.unit_vectors(spark, 60, 4), path)
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 2
    S.drop_dataset(spark, path)
    assert not os.path.exists(path)
    name, versions = "nnprobe_failed_write", scratch_path(spark, "versions")
    S.write_table(good, name, versions)
    with pytest.raises(Exception, match="broken"):
        S.write_table(bad, name, versions)
    assert spark.table(name).count() == 40
    S.write_table(good.withColumn("more", F.lit(1)), name, versions)            # another schema
    assert spark.table(name).columns[-1] == "more" and spark.table(name).count() == 40
    S.drop_table(spark, name, versions)
    assert not spark.catalog.tableExists(name) and not os.path.exists(versions)


def test_index_manifest_lookup(spark):
    b = base(spark, SF001)
    c = ivf.train_sample(b, 4, "l2")
    idx = ivf.build_index(b, c, "l2")
    man = idx.manifest(spark, "embeddings", "embedding")
    other = spark.createDataFrame([("bt", "btree", "embeddings", ["embedding"], "l2", 0, 1, None, "")],
                                  "index_name string, kind string, table string, columns array<string>, metric string, "
                                  "lists int, size_bytes long, created_at timestamp, definition string")
    manifest = man.unionByName(other, allowMissingColumns=True)
    hit = profile.index_lookup(manifest, "embeddings", "embedding").first()
    assert hit.kind == "ivfflat" and hit.lists == 4 and hit.size_bytes > 0
    miss = profile.index_lookup(manifest, "embeddings", "other").first()
    assert miss.kind == "none" and miss.index_name is None


def test_index_lookups_equal_one_by_one(spark):
    kinds = ("index_name string, kind string, table string, columns array<string>, metric string, lists int, size_bytes long, created_at timestamp")
    import datetime
    at = lambda n: datetime.datetime(2024, 1, 1 + n)
    m = spark.createDataFrame([("a", "hnsw", "t", ["x", "y"], "l2", 1, 1, at(1)), ("b", "ivfflat", "t", ["y"], "l2", 2, 2, at(2)),
                               ("c", "ivfflat", "t", ["y", "y"], "l2", 3, 3, at(2)), ("d", "btree", "t", ["z"], "l2", 4, 4, at(3)),
                               ("e", "hnsw", "u", ["x"], "l2", 5, 5, None)], kinds)
    asked = spark.createDataFrame([("t", "x"), ("t", "y"), ("t", "y"), ("t", "z"), ("u", "x"), ("v", "x")], "table string, column string")
    got = {(r.table, r.column): (r.index_name, r.kind) for r in profile.index_lookups(m, asked).collect()}
    assert got == {("t", "x"): ("a", "hnsw"), ("t", "y"): ("b", "ivfflat"), ("t", "z"): (None, "none"), ("u", "x"): ("e", "hnsw"),
                   ("v", "x"): (None, "none")}
    for (t, c), want in got.items():
        one = profile.index_lookup(m, t, c).first()
        assert (one.index_name, one.kind) == want


def test_stored_size_opens_no_file(spark):
    df = table(spark, SF001, "embeddings")
    plan = profile.stored_size(df)._jdf.queryExecution().executedPlan().toString()
    assert "binaryfile" in plan.lower() and "content" not in plan.split("ReadSchema")[1]
    assert profile.stored_size(spark.range(3)).first().files == 0


def test_timed_search(spark):
    from nnprobe.operators import knn, runlog, sampling
    b = base(spark, SF001)
    q = sampling.sample_queries(b, 30)
    log, found, truth = runlog.timed_evaluation(spark, b, q, 5, 8, (1, 8), "t", exclude_self=False)
    notes = log.rows(spark).collect()
    assert [n.phase for n in notes] == ["build", "truth", "search", "search"]
    full = found.where("effort = 8").select("qid", "rank", "id")
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, knn.exact_knn(b, q, 5, "cosine", exclude_self=False).select("qid", "rank", "id").collect()))
    searches = [n for n in notes if n.phase == "search"]
    assert searches[1].compared == 30 * 500 and searches[0].compared < searches[1].compared
    assert all(n.ended_us > n.started_us and n.dur_ms > 0 and n.queries == 30 for n in searches) and searches[1].found == 150
    p = scratch_path(spark, "own-run")
    sinks.write_measurements(log.rows(spark), p)
    assert sinks.measurement_runs(spark, p).first().rows == 4


def test_result_document(spark):
    env = profile.profile(base(spark, SF001))
    lat = M.latency_summary(M.from_events(table(spark, SF001, "events")), group=()).drop("run_id")
    lv = M.levels(M.from_events(table(spark, SF001, "events")))
    pts = spark.createDataFrame([(0, 1, 0.5), (1, 4, 0.9)], "sweep_idx int, effort int, recall double")
    doc = sinks.result_document(env, {"metric": "cosine", "k": 10, "concurrency": [1, 8]}, lat, lv, pts,
                                recall.default_point(pts, 4))
    r = doc.first()
    assert r.config.k == 10 and len(r.throughput.levels) == 5 and r.recall.default.effort == 4
    out = sinks.write_document(doc, scratch_path(spark, "doc"))
    assert spark.read.json(out).first().recall.points[1].recall == 0.9


def test_release_removes_scratch(spark):
    from nnprobe.session import release, stored
    kept, at = stored(spark.range(3), "kept")
    _, gone = stored(spark.range(3), "gone")
    release(spark, keep=(at,))
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file:"))
    release(spark)
    assert not os.path.exists(at.removeprefix("file:"))


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    import pytest
    from types import SimpleNamespace
    from nnprobe.session import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None)))
    remote = SimpleNamespace(get=lambda k, d=None: "s3a://bucket/x/")
    sc = SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: "s3a://bucket/x")
    assert shared_dir(SimpleNamespace(conf=remote, sparkContext=sc)) == "s3a://bucket/x"
