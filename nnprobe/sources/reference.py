"""Reference-benchmark source (S6): a JSON document
``{generated_at, method_url, buckets: [...]}`` read with an explicit schema.
Zero buckets is a normal state (the projection then always declines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_FIELDS = ("dim int, rows long, index string, m int, ef_construction int, ef_search int, "
                 "qps double, p50_ms double, p95_ms double, recall double")


def _doc_schema() -> str:
    fields = ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ") for f in BUCKET_FIELDS.split(",")))
    return f"generated_at string, method_url string, buckets array<struct<{fields}>>"


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Buckets as rows (bucket_pos = position in the document)."""
    doc = spark.read.schema(_doc_schema()).option("multiLine", True).json(path)
    return doc.select(F.posexplode("buckets").alias("bucket_pos", "b")).select(
        F.col("bucket_pos").cast("int"), "b.*")


def reference_info(spark: SparkSession, path: str) -> DataFrame:
    """(generated_at, method_url, bucket_count): the document's header."""
    doc = spark.read.schema(_doc_schema()).option("multiLine", True).json(path)
    return doc.select("generated_at", "method_url", F.coalesce(F.size("buckets"), F.lit(0)).alias("bucket_count"))
