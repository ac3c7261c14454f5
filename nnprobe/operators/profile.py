"""Table profile (P1-P5, P7): one pass of aggregates over the vector table.

Spark arrays carry no declared length, so the dimension is measured
(min and max size) and ragged rows are counted instead of assumed away.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.functions.distance import norm
from nnprobe.functions.text import format_bytes

# Fixed index kinds recognised by the lookup.
INDEX_KINDS = ("hnsw", "ivfflat")


def profile(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Rows, dimension range, vector health; one row."""
    v = F.col(vec_col)
    n = norm(v)
    return (df.select(v.alias("v"), n.alias("n"), F.size(v).alias("s"))
            .agg(F.count("*").alias("rows"),
                 F.min(F.when(F.col("v").isNotNull(), F.col("s"))).alias("dim_min"),
                 F.max(F.when(F.col("v").isNotNull(), F.col("s"))).alias("dim_max"),
                 F.count_if(F.col("v").isNull()).alias("null_vectors"),
                 F.count_if(F.col("n") == 0).alias("zero_norm"),
                 F.min("n").alias("min_norm"),
                 F.max("n").alias("max_norm"))
            .withColumn("dim_min", F.col("dim_min").cast("int"))
            .withColumn("dim_max", F.col("dim_max").cast("int")))


def check_dimension(prof_row) -> int:
    """Raise when the table has more than one vector length."""
    if prof_row["dim_min"] != prof_row["dim_max"]:
        raise ValueError(f"ragged vectors: sizes {prof_row['dim_min']}..{prof_row['dim_max']}")
    return int(prof_row["dim_min"] or 0)


def stored_size(df: DataFrame) -> DataFrame:
    """Bytes of the files behind a file-source DataFrame, from their
    listing: the files are not opened."""
    spark, paths = df.sparkSession, df.inputFiles()
    if not paths:
        return spark.range(1).select(F.lit(None).cast("long").alias("table_size_bytes"), F.lit(0).cast("long").alias("files"))
    # path and length are the listing's; the content column is not read
    return (spark.read.format("binaryFile").load([unquote(p) for p in paths])
            .agg(F.sum("length").cast("long").alias("table_size_bytes"), F.count("path").alias("files")))


def index_lookup(manifest: DataFrame, table: str, column: str) -> DataFrame:
    """P5: the index on (table, column), or one row with kind 'none'.

    Kinds other than hnsw/ivfflat are ignored; among several matches the
    newest wins (ties by name), so the answer is deterministic.
    """
    spark = manifest.sparkSession
    hit = (manifest.where(F.col("kind").isin(*INDEX_KINDS) & (F.col("table") == table)
                          & F.array_contains("columns", column))
           .orderBy(F.col("created_at").desc(), "index_name").limit(1))
    one = spark.range(1).select(F.lit(table).alias("table"), F.lit(column).alias("column"))
    return (one.join(hit.drop("table"), F.lit(True), "left")
            .select("table", "column", "index_name",
                    F.coalesce("kind", F.lit("none")).alias("kind"),
                    "metric", "lists", "size_bytes",
                    *[F.col(c) if c in hit.columns else F.lit(None).cast("string").alias(c) for c in ("path", "centroids_path")]))


def index_lookups(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """P5 for many columns: every distinct (table, column) of ``asked`` with
    the index that ``index_lookup`` finds for it.  The manifest is taken apart
    by column and reduced to one index per key before it meets the requests."""
    have = manifest.where(F.col("kind").isin(*INDEX_KINDS)).withColumn("column", F.explode(F.array_distinct("columns")))
    fields = ["index_name", "kind", "metric", "lists", "size_bytes", *[c for c in ("path", "centroids_path") if c in manifest.columns]]
    newest = have.groupBy("table", "column").agg(F.max("created_at").alias("_newest"))
    # of equally new ones the first by name
    best = (have.join(newest, ["table", "column"]).where(F.col("created_at").eqNullSafe(F.col("_newest")))
            .groupBy("table", "column").agg(F.min_by(F.struct(*fields), "index_name").alias("_i")))
    got = asked.select("table", "column").distinct().join(best, ["table", "column"], "left")
    return got.select("table", "column", *[F.col(f"_i.{c}").alias(c) for c in fields]).withColumn(
        "kind", F.coalesce("kind", F.lit("none")))


def facts(prof: DataFrame, table: str, column: str, extra: dict | None = None) -> DataFrame:
    """The profile as (key, value) text rows."""
    kv = [("table", F.lit(table)),
          ("rows", F.format_number(F.col("rows"), 0)),
          ("column", F.concat(F.lit(column), F.lit(" vector("), F.col("dim_max").cast("string"), F.lit(")"))),
          ("null_vectors", F.col("null_vectors").cast("string")),
          ("zero_norm", F.col("zero_norm").cast("string"))]
    for k, v in (extra or {}).items():
        kv.append((k, F.lit(str(v))))
    m = F.create_map(*[x for k, v in kv for x in (F.lit(k), v)])
    pos = F.posexplode(m)
    return prof.select(pos.alias("pos", "key", "value")).select(F.col("pos").cast("int"), "key", "value")


def index_facts(lookup: DataFrame, sizes: DataFrame) -> DataFrame:
    """The table's stored size and the index found, as (key, value) rows:
    its kind, parameters and size, or "none"."""
    kind = F.col("kind")
    params = F.when(F.col("lists") > 0, F.concat(F.lit(" lists="), F.col("lists").cast("string"))).otherwise(F.lit(""))
    index = F.when(kind == "none", F.lit("none")).otherwise(F.concat(kind, params, F.lit(" · "), format_bytes("size_bytes")))
    both = lookup.select(F.struct(F.lit("index").alias("key"), index.alias("value")).alias("i")).crossJoin(     # one row each
        sizes.select(F.struct(F.lit("table size").alias("key"), format_bytes("table_size_bytes").alias("value")).alias("t")))
    return both.select(F.explode(F.array("t", "i")).alias("r")).select("r.key", "r.value")
