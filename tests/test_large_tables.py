"""Queries over a table of more than 100,000 vectors give what their SQL gives."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from nnprobe.operators import sampling

ROWS, DIM = 100_500, 8


def _vectors(spark):
    x = [((F.xxhash64("id", F.lit(j)) % 1_000_000) / 1e6).cast("float") for j in range(DIM)]
    return spark.range(0, ROWS, 1, 12).select("id", F.array(*x).alias("embedding"))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large"))
    _vectors(spark).select(F.col("id").alias("vec_id"), "embedding", (F.col("id") % 10).cast("int").alias("label")).write.parquet(
        f"{path}/embeddings.parquet")
    shutil.copy(f"{SF001}/events.parquet", path)
    return path


@pytest.fixture(scope="module")
def con(large):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{large}/embeddings.parquet/*.parquet')")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{large}/events.parquet')")
    return c


def _norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["ivf_cost", "ivf_kmeans_sweep", "recall_sweep", "result_document"])
def test_large_table_matches_oracle(spark, large, con, name):
    df = E.queries()[name](spark, large)
    res = con.execute(E.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert _norm(map(tuple, df.collect())) == _norm(tuple(r[i] for i in at) for r in res.fetchall())


def test_draw_does_not_depend_on_files(spark, large):
    """The same queries from 12 files, from rows that are in no file, and in order of their keys."""
    stored = spark.read.parquet(f"{large}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    want = [r.id for r in stored.select("id", sampling.sample_key("id").alias("k")).orderBy("k", "id").limit(30).collect()]
    for df in (stored, _vectors(spark)):
        drawn, some = sampling.draw_queries(df, 20, 30)
        assert [r.qid for r in drawn.orderBy("pos").collect()] == want
        assert {r.qid for r in some.collect()} == set(want)


def test_sample_does_not_depend_on_the_row_count(spark, large):
    """A given row count is a hint only: blocks are sampled where a threshold is given."""
    stored = spark.read.parquet(f"{large}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    want = [tuple(r) for r in sampling.sample_queries(stored, 30).select("pos", "qid").orderBy("pos").collect()]
    for rows in (ROWS, 100 * ROWS):
        assert [tuple(r) for r in sampling.sample_queries(stored, 30, rows=rows).select("pos", "qid").orderBy("pos").collect()] == want
    # W3 on request: one of the 12 files is read
    some = sampling.sample_queries(stored, 30, rows=ROWS, threshold=100_000).join(stored.withColumnRenamed("id", "qid"), "qid")
    assert some.select(F.input_file_name()).distinct().count() == 1
