import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from nnprobe.operators import kernel, knn, sampling
from nnprobe.plans.catalog_vectors import base


def _bq(spark, scaled=True, n=30):
    b = base(spark, SF001, scaled)
    return b, sampling.sample_queries(b, n, seed=42)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_block_equals_expr(spark, metric):
    b, q = _bq(spark)
    a = rows(knn.exact_knn(b, q, 10, metric, strategy="block"), "qid", "rank")
    e = rows(knn.exact_knn(b, q, 10, metric, strategy="expr"), "qid", "rank")
    assert a == e
    assert len(a) == 300


def test_self_excluded_and_included(spark):
    b, q = _bq(spark, scaled=False)
    ex = knn.exact_knn(b, q, 5, "cosine")
    assert ex.where(F.col("id") == F.col("qid")).count() == 0
    inc = knn.exact_knn(b, q, 5, "cosine", exclude_self=False)
    # unit vectors: the row itself is at distance 0, rank 1
    assert inc.where((F.col("rank") == 1) & (F.col("id") == F.col("qid"))).count() == 30


def test_inner_product_self_not_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [4.0, 0.0])],
                               "id long, embedding array<float>")
    q = sampling.sample_queries(df.where("id = 1"), 1)
    for strategy in ("block", "expr"):
        got = [r.id for r in knn.exact_knn(df, q, 2, "ip", strategy=strategy).orderBy("rank").collect()]
        assert got == [4, 3]


def test_duplicates_keep_other_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    q = sampling.sample_queries(df.where("id = 1"), 1)
    got = [r.id for r in knn.exact_knn(df, q, 2, "l2").orderBy("rank").collect()]
    assert got == [2, 3]


def test_null_and_ragged_rows_skipped(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5, 0.5]), (4, [0.0, 1.0])],
                               "id long, embedding array<float>")
    q = sampling.sample_queries(df.where("id = 1"), 1)
    for strategy in ("block", "expr"):
        got = [r.id for r in knn.exact_knn(df, q, 5, "l2", strategy=strategy).orderBy("rank").collect()]
        assert got == [4]


def test_query_chunks(spark, monkeypatch):
    b, q = _bq(spark, n=40)
    want = rows(knn.exact_knn(b, q, 10, "l2"), "qid", "rank")
    monkeypatch.setattr(knn, "MAX_QUERY_BYTES", 64 * 4 * 7)      # 7 queries per pass
    monkeypatch.setattr(kernel, "BLOCK_CELLS", 50)               # tiny sub-blocks
    monkeypatch.setattr(kernel, "MERGE_ROWS", 20)                # frequent cuts
    for strategy in ("block", "expr"):
        assert rows(knn.exact_knn(b.repartition(5), q, 10, "l2", strategy=strategy), "qid", "rank") == want


def test_scan_audit(spark):
    b, q = _bq(spark, scaled=False)
    truth, compared = knn.audited_knn(b, q, 10, "cosine")
    assert rows(truth, "qid", "rank") == rows(knn.exact_knn(b, q, 10, "cosine"), "qid", "rank")
    a = knn.scan_audit(b, q, truth, compared, 10).collect()
    assert len(a) == 30 and all(r.valid for r in a)
    assert {r.scanned for r in a} == {499}
    # truth from half of the table is found out, and so is a truth that lost rows
    half, seen = knn.audited_knn(b.where("id % 2 = 0"), q, 10, "cosine")
    assert not any(r.valid for r in knn.scan_audit(b, q, half, seen, 10).collect())
    lost = knn.scan_audit(b, q, truth.where("rank < 10"), compared, 10).collect()
    assert not any(r.valid for r in lost)


def test_large_k(spark):
    b, q = _bq(spark, n=2)
    got = knn.exact_knn(b, q, 5000, "l2")
    assert got.count() == 2 * 499
    with pytest.raises(ValueError):
        knn.exact_knn(b, q, 0, "l2")


INF = float("inf")
ODD = [[1e20, 1.0], [2e20, 0.0], [3e20, 0.0], [1e-25, 2e-25], [3e-25, 1e-25], [3.0, 0.0], [1e-45, 0.0], [0.0, 0.0], [3.4e38, 3.4e38],
       [-3.4e38, 3.4e38], [INF, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0, -INF], [1.0, 1.0], [2.0, 2.0]]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_forms_agree_on_extreme_values(spark, metric, k):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, embedding array<float>")
    q = df.select(F.col("id").cast("int").alias("pos"), F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    block = rows(knn.exact_knn(df, q, k, metric), "qid", "rank")
    expr = rows(knn.exact_knn(df, q, k, metric, strategy="expr"), "qid", "rank")
    assert block == expr
    # 12 vectors are searchable, as rows and as queries
    assert len(block) == 12 * min(k, 11)
