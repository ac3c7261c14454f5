import numpy as np
import pytest

from nnprobe.functions import distance as D

FIX = [((1, 0), (0, 2), 2.236068, 0.0, 1.0),
       ((1, 2), (3, 4), 2.828427, -11.0, 0.016130),
       ((0, 0), (1, 0), 1.0, 0.0, 1.0),
       ((1, 2), (1, 2), 0.0, -5.0, 0.0)]


def test_fixture_distances(spark):
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b, *_ in FIX],
                               "a array<float>, b array<float>")
    out = df.select(D.l2("a", "b"), D.neg_ip("a", "b"), D.cosine("a", "b")).collect()
    for (_, _, l2, ip, cos), r in zip(FIX, out):
        assert r[0] == pytest.approx(l2, abs=1e-6)
        assert r[1] == pytest.approx(ip, abs=1e-6)
        assert r[2] == pytest.approx(cos, abs=1e-6)
    # 0, not -0: the sign bit must be clear
    assert np.signbit(out[0][1]) == False  # noqa: E712


def test_unequal_length_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<float>, b array<float>")
    r = df.select(D.l2("a", "b"), D.neg_ip("a", "b"), D.cosine("a", "b")).first()
    assert tuple(r) == (None, None, None)


def test_unknown_metric_raises():
    with pytest.raises(ValueError):
        D.distance("hamming", "a", "b")


def test_numpy_twin_bit_equal(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(50, 33)).astype(np.float32)
    b = rng.normal(size=(50, 33)).astype(np.float32)
    a[3] = 0
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(50)],
                               "i int, a array<float>, b array<float>")
    for m in D.METRICS:
        got = [r[0] for r in df.orderBy("i").select(D.distance(m, "a", "b")).collect()]
        want = D.np_exact(m, a.astype(np.float64), b.astype(np.float64))
        assert np.array_equal(np.array(got), want), m


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    r = df.select(D.normalize("v").alias("n")).collect()
    assert r[0].n == pytest.approx([0.6, 0.8])
    assert r[1].n == [0.0, 0.0]


def test_numpy_normalize_bit_equal(spark):
    rng = np.random.default_rng(9)
    a = (rng.normal(size=(40, 17)) * rng.uniform(0.01, 100, size=(40, 1))).astype(np.float32)
    a[5] = 0.0
    df = spark.createDataFrame([(i, a[i].tolist()) for i in range(40)], "i int, v array<float>")
    got = np.array([r[0] for r in df.orderBy("i").select(D.normalize("v")).collect()], dtype=np.float32)
    assert np.array_equal(got, D.np_normalize(a))
