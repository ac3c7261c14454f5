"""Shared helpers: tables, shared scratch storage, positions without one big window, components."""

from __future__ import annotations

import tempfile
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed text classes of the query contracts.
SPACE = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Local
    sessions without the setting get a temporary one; a cluster without it
    is an error, as a machine-local folder would be invisible to others."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="nnprobe-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_STORED: list[str] = []        # folders written by this session, in order


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts
    the lineage, survives lost executors and gives exact sizes to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    _STORED.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STORED.remove(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the table that ``store`` returned as ``df`` and that nothing needs any more."""
    if getattr(df, "_stored_at", None) in _STORED:
        _delete(df.sparkSession, df._stored_at)


def stored_so_far() -> int:
    return len(_STORED)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the stored tables from the ``since``-th on, but for ``keep``.
    The tables behind a result must stay until the result has been written."""
    for path in _STORED[since:]:
        if path != getattr(keep, "_stored_at", None):
            _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(df: DataFrame, **cols) -> DataFrame:
    """``df`` with columns that are evaluated once per row: a one-row
    generator, into which neither projections nor filters are merged (an
    array that a lambda reads would else be built again for each element)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def map_rows(df: DataFrame, make, schema: str | T.StructType, batch_rows: int = 2048) -> DataFrame:
    """``df`` through ``make``, which turns a task's iterator of row tuples
    into an iterator of row tuples of ``schema``."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        rows = make(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        while part := list(islice(rows, batch_rows)):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def running_totals(df: DataFrame, keys: list, sums: dict[str, str], name: str) -> DataFrame:
    """Global order by ``keys`` with totals of all earlier rows.

    ``sums`` maps a new column to the column it adds up; ``_pos`` counts the
    rows before.  The rows are range-partitioned and stored with their
    partition number, so the offsets (one row per partition) and the local
    windows see the same split; no task ever holds more than a range.  Keys
    must end in something that splits ties, or a hot key stays in one range.
    """
    spark = df.sparkSession
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    part = store(df.repartitionByRange(shuffle_partitions(spark), *order)
                 .withColumn("_pid", F.spark_partition_id()), name)
    per = part.groupBy("_pid").agg(F.count("*").alias("_n"),
                                   *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                     *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    here = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = part.join(F.broadcast(off), "_pid")        # one row per shuffle partition
    cols = [(F.col("_n0") + F.coalesce(F.count(F.lit(1)).over(here), F.lit(0))).alias("_pos")]
    cols += [(F.col(f"_o_{k}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(k) for k, c in sums.items()]
    return out.select(*df.columns, *cols)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest reachable id per node of an undirected graph (a, b): (v, label).

    Alternating large-star and small-star steps; each is one aggregation and
    one equi-join, and the edge table is stored between rounds.  The number
    of edges never grows, so hubs cost what their edges cost.  It ends when
    every node has one parent and no parent has one itself.
    """
    cur, kept = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")), None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        cur = store(small, name)
        if kept is not None:
            drop_stored(kept)
        kept = cur
        parents = cur.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        chained = cur.join(cur.select(F.col("v").alias("u")), "u", "left_semi")
        if chained.isEmpty() and parents.where(F.col("lo") < F.col("hi")).isEmpty():
            break
    return cur.select(F.col("u").alias("v"), F.col("v").alias("label"))
