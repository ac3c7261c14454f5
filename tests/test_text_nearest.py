import pytest
from pyspark.sql import functions as F

from nnprobe.functions import privacy
from nnprobe.functions.text import format_bytes, format_int, parse_index_def, rows_bucket, short_version
from nnprobe.operators import nearest


def test_rows_bucket(spark):
    df = spark.createDataFrame([(n,) for n in (999, 1000, 9999, 10000, 99_999_999, 100_000_000)], "n long")
    assert [r[0] for r in df.select(rows_bucket("n")).collect()] == ["<1k", "1k", "1k", "10k", "10M", ">100M"]


def test_formats(spark):
    df = spark.createDataFrame([(1234567, 1023, "Engine 17.10 on x86_64")], "a long, b long, v string")
    r = df.select(format_int("a"), format_bytes("b"), format_bytes(F.lit(1536)), format_bytes(F.lit(1280)),
                  short_version("v"), format_int(F.lit(-1234))).first()
    assert tuple(r) == ("1,234,567", "1023 B", "1.5 KiB", "1.2 KiB", "Engine 17.10", "-1234")


def test_index_def(spark):
    ddl = ["CREATE INDEX i ON t USING hnsw (embedding vector_cosine_ops) WITH (m='16', ef_construction='64')",
           "CREATE INDEX i ON t USING ivfflat (embedding vector_l2_ops) WITH (lists='100')",
           "CREATE INDEX i ON t USING hnsw (embedding halfvec_l2_ops)"]
    df = spark.createDataFrame([(d,) for d in ddl], "d string")
    p = parse_index_def("d")
    got = [tuple(r) for r in df.select(p["m"], p["ef_construction"], p["lists"], p["opclass"]).collect()]
    assert got == [(16, 64, 0, "vector_cosine_ops"), (0, 0, 100, "vector_l2_ops"), (0, 0, 0, "halfvec_l2_ops")]


SCRUB = [("dial tcp 10.0.0.5:5432: refused", "dial tcp <ip>: refused"),
         ("connect postgres://u:p@h.example.com:5432/db failed", "connect postgres://<redacted> failed"),
         ("lookup db.example.com:5432: no such host", "lookup <host>: no such host"),
         ("to `user=bob database=x`: timeout", "to `<conn>`: timeout"),
         ("to `host=h.example.com user=bob`", "to `host=<host> user=bob`"),
         ("see file.txt, version 17.10", "see <host>, version 17.10"),
         ("café10.0.0.5 x", "café<ip> x")]


def test_scrub(spark):
    df = spark.createDataFrame([(a,) for a, _ in SCRUB], "t string")
    got = [r[0] for r in df.select(privacy.scrub("t")).collect()]
    assert got == [b for _, b in SCRUB]
    again = [r[0] for r in spark.createDataFrame([(g,) for g in got], "t string").select(privacy.scrub("t")).collect()]
    assert again == got


def test_redact(spark):
    urls = [("postgres://bob:pw@h/db", "postgres://bob:***@h/db"), ("postgres://bob@h/db", "postgres://bob@h/db"),
            ("http://h:80/x?y=a:b@c", "http://h:80/x?y=a:b@c"), ("postgres://h/%zz", "<redacted>"),
            ("postgres://u:p@ss@h/db", "postgres://u:***@h/db"), ("postgres://a@b:pw@h/db", "postgres://a%40b:***@h/db"),
            ("//u:pw@h/db", "//u:***@h/db"), ("postgres://u:p@h:54x/db", "<redacted>"), ("postgres://u:p@h:5432/db", "postgres://u:***@h:5432/db"),
            ("postgres://u@h:5432/db", "postgres://u@h:5432/db"), ("postgres://u:@h", "postgres://u:***@h"),
            ("postgres://u:p w@h/db", "<redacted>"), ("postgres://u:p@[::1]:5432/db", "postgres://u:***@[::1]:5432/db"),
            ("postgres://u:p@[::1/db", "<redacted>"), ("postgres://u:p@[::1]x/db", "<redacted>"), ("x y:z", "<redacted>"),
            ("postgres://u:p@h?q=a@b:c", "postgres://u:***@h?q=a@b:c"), ("postgres://h:/db", "postgres://h:/db"), ("", "")]
    df = spark.createDataFrame([(a,) for a, _ in urls], "u string")
    assert [r[0] for r in df.select(privacy.redact_url("u")).collect()] == [b for _, b in urls]


BUCKETS = [(0, 768, 1_000_000, "hnsw", 100), (1, 768, 100_000, "hnsw", 40), (2, 1536, 1_000_000, "ivfflat", 100)]


@pytest.mark.parametrize("bucket,query,found,d", [
    (0, (1536, 1_000_000, 100), True, 0.166667),
    (1, (1536, 1_000_000, 100), False, None),
    (1, (1536, 1_000_000, 0), True, 0.466667)])
def test_nearest_fixtures(spark, bucket, query, found, d):
    b = spark.createDataFrame([BUCKETS[bucket], BUCKETS[2]],
                              "bucket_pos int, dim int, rows long, index string, ef_search int")
    w = spark.createDataFrame([(1,) + query + ("hnsw",)], "workload_id int, dim int, rows long, ef_search int, index string")
    r = nearest.nearest_reference(w, b).first()
    assert r.found == found
    if found:
        assert r.distance_norm == pytest.approx(d, abs=1e-6) and r.bucket_pos == bucket


def test_nearest_no_buckets_keeps_row(spark):
    b = spark.createDataFrame([], "bucket_pos int, dim int, rows long, index string, ef_search int")
    w = spark.createDataFrame([(1, 64, 10, 0, "")], "workload_id int, dim int, rows long, ef_search int, index string")
    r = nearest.nearest_reference(w, b).collect()
    assert len(r) == 1 and r[0].found is False


def test_nearest_first_on_ties(spark):
    b = spark.createDataFrame([(5, 64, 100, "ivfflat", 0), (2, 64, 100, "ivfflat", 0)],
                              "bucket_pos int, dim int, rows long, index string, ef_search int")
    w = spark.createDataFrame([(1, 64, 100, 0, "")], "workload_id int, dim int, rows long, ef_search int, index string")
    assert nearest.nearest_reference(w, b).first().bucket_pos == 2


def test_comparison_rows(spark):
    m = spark.createDataFrame([(1.0, 2.0, 30.0, 0.9, 0)], "p50_ms double, p95_ms double, peak_qps double, recall double, effort int")
    r = {x.metric: (x.measured, x.projected) for x in nearest.comparison_rows(m).collect()}
    assert r == {"p50_ms": (1.0, None), "p95_ms": (2.0, None), "peak_qps": (30.0, None), "recall": (None, None)}


def test_effort_fallback(spark):
    df = spark.createDataFrame([(100, 40), (0, 40), (0, 0), (None, 7)], "d int, idx int")
    got = [r[0] for r in df.select(nearest.effort_for_projection(F.col("d"), F.col("idx"))).collect()]
    assert got == [100, 40, 0, 7]


def test_shape_row(spark):
    df = spark.createDataFrame([(1536, 1_234_567, 40.84, 68.6, 0.99951)], "dim int, rows long, p95 double, qps double, r double")
    r = df.select(*nearest.shape_row("dim", "rows", "cosine", F.col("p95"), F.col("qps"), F.col("r"), "hnsw")).first()
    assert tuple(r) == (1536, "1M", "cosine", "40.8", "69", "1.000", "hnsw")
    assert set(r.asDict()) == {"dims", "rows_bucket", "metric", "p95", "qps", "recall", "index"}
