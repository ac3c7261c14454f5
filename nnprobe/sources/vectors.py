"""Vector table source.

The vector table is any DataFrame source (parquet path or catalog table)
with a 64-bit key and an ARRAY<FLOAT> column; only those two columns are
read (Catalyst prunes the rest at the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, source: str, id_col: str = "id", vec_col: str = "embedding",
                 fmt: str = "parquet") -> DataFrame:
    """(id LONG, embedding ARRAY<FLOAT>) from a path or a table name.
    NULL vectors are kept (searches skip them, sampling never draws them)."""
    df = spark.read.table(source) if fmt == "table" else spark.read.format(fmt).load(source)
    return df.select(F.col(id_col).cast("long").alias("id"),
                     F.col(vec_col).cast("array<float>").alias("embedding"))
