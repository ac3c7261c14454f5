"""Exact k-nearest neighbours (K1-K5).

Two physical forms of one answer:

* ``block`` - the form for use: the query matrix is broadcast once per
  executor and each Arrow batch of the table becomes one matrix product in
  ``mapInArrow``; only the per-partition top-k per query is shuffled.
* ``expr``  - the oracle form, for tests: nested-loop join with the broadcast
  query set, distance as a JVM expression.  It emits queries x rows pairs.

Both rank under the total order (distance, id) and return
``qid, rank, id, distance``.  Vectors that are NULL or hold a NULL, NaN or
infinite element are not searchable: no form compares them, as rows or as
queries.  Self exclusion filters ``id <> qid`` before ranking, which equals
"fetch k+1 then drop the first self match".
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.functions.distance import check_metric, cosine_from_parts, distance, dot, searchable, sq_norm
from nnprobe.operators.kernel import TOPK_SCHEMA, topk_per_partition
from nnprobe.session import spread, stored

# Bytes of one slice of the query matrix; a larger query set takes several passes.
MAX_QUERY_BYTES = 256 * 1024 * 1024


def _base(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
            .where(F.col("v").isNotNull()))


def query_matrix(queries: DataFrame):
    """One slice of the query set as numpy: (qid, float32 matrix, dimension)."""
    tbl = queries.select(F.col("qid").cast("long").alias("qid"), "qv").toArrow()
    qid = tbl.column("qid").to_numpy()
    arr = tbl.column("qv").combine_chunks()
    lens = arr.value_lengths().to_numpy(zero_copy_only=False)
    if len(qid) and (np.isnan(lens.astype(float)).any() or len(set(lens.tolist())) != 1):
        raise ValueError("query vectors must be non-NULL and of one dimension")
    dim = int(lens[0]) if len(qid) else 0
    mat = arr.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(qid), dim)
    return qid.astype(np.int64), mat, dim


def query_chunks(queries: DataFrame, max_bytes: int | None = None, extra: int = 0) -> list[DataFrame]:
    """Split a (pos, qid, qv) query set into slices of at most ``max_bytes``
    of float32 matrix (and ``extra`` bytes per query), by ranges of ``pos``
    (by hash of the id in sets without it); each slice is brought to the driver
    only when its own pass is planned, so the driver never holds more than one
    slice."""
    max_bytes = max_bytes or MAX_QUERY_BYTES
    placed = "pos" in queries.columns
    pos = F.col("pos") if placed else F.lit(0)
    stats = queries.agg(F.count("*").alias("n"), F.max(F.size("qv")).alias("dim"),
                        F.min(pos).alias("lo"), F.max(pos).alias("hi")).first()
    if not stats["n"]:
        return [queries]
    per_pass = max(1, max_bytes // max(int(stats["dim"] or 0) * 4 + extra, 1))
    if stats["n"] <= per_pass:
        return [queries]
    if not placed:
        parts = -(-stats["n"] // max(1, per_pass * 3 // 4))       # the hash deals them unevenly
        return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p) for p in range(parts)]
    return [queries.where((F.col("pos") >= s) & (F.col("pos") < s + per_pass))
            for s in range(int(stats["lo"]), int(stats["hi"]) + 1, per_pass)]


def rank_topk(cand: DataFrame, k: int) -> DataFrame:
    """Top-k per qid under (distance, id).  Spark cuts each map task's rows
    to k per query before the shuffle, so a reducer gets at most tasks x k."""
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return (cand.withColumn("rank", F.row_number().over(w).cast("int"))
            .where(F.col("rank") <= k)
            .select("qid", "rank", "id", "distance"))


def _block_scan(b: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    sc = b.sparkSession.sparkContext
    parts = None
    for chunk in query_chunks(queries):
        qid, mat, dim = query_matrix(chunk)
        bc = sc.broadcast({"qid": qid, "mat": mat})
        part = b.mapInArrow(topk_per_partition(bc, metric, k, exclude_self, dim, "id", "v"), TOPK_SCHEMA)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def exact_knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
              exclude_self: bool = True, strategy: str = "block",
              id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """K1-K4: the k nearest rows of the whole table for every query.

    ``queries``: (pos, qid, qv) from ``sample_queries``.  Rows that are not
    searchable are never candidates (K4); rows whose length differs from the
    queries' give no distance and are skipped.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be positive")
    if strategy not in ("block", "expr"):
        raise ValueError(f"unknown strategy {strategy!r}")
    b = _base(base, id_col, vec_col)
    if strategy == "block":
        return rank_topk(_block_scan(b, queries, k, metric, exclude_self).where(F.col("id").isNotNull()), k)
    b = spread(b).where(searchable("v"))         # per-pair work is a JVM fold
    cand = None
    for chunk in query_chunks(queries):
        q = chunk.where(searchable("qv")).select("qid", "qv")
        if metric == "cosine":
            # norms once per row on each side, only the dot product per pair
            b2, q = b.withColumn("nv", sq_norm("v")), q.withColumn("nq", sq_norm("qv"))
            d = F.when(F.size("v") == F.size("qv"), cosine_from_parts(dot("qv", "v"), F.col("nq"), F.col("nv")))
        else:
            b2, d = b, distance(metric, "qv", "v")
        pairs = b2.crossJoin(F.broadcast(q))      # one slice of the stated query set
        if exclude_self:
            pairs = pairs.where(F.col("id") != F.col("qid"))
        part = pairs.select("qid", "id", d.alias("distance")).where(F.col("distance").isNotNull())
        cand = part if cand is None else cand.unionByName(part)
    return rank_topk(cand, k)


def audited_knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = True,
                id_col: str = "id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(truth, compared) of one scan: the exact neighbours, and per query the
    number of rows the kernel compared it with (input of ``scan_audit``)."""
    check_metric(metric)
    got, _ = stored(_block_scan(_base(base, id_col, vec_col), queries, k, metric, exclude_self), "knn-scan")
    compared = got.where(F.col("id").isNull()).groupBy("qid").agg(F.sum("compared").alias("compared"))
    return rank_topk(got.where(F.col("id").isNotNull()), k), compared


def scan_audit(base: DataFrame, queries: DataFrame, truth: DataFrame, compared: DataFrame, k: int,
               id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """K5: the truth is valid only if the whole table was compared.

    ``scanned`` is what the search itself counted.  It must equal the number
    of searchable rows of the table less the query's own, counted here apart
    from the search, and the truth must hold min(k, scanned) rows."""
    b = _base(base, id_col, vec_col).where(searchable("v"))
    sizes = b.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    qids = F.broadcast(queries.select(F.col("qid").alias("id")))        # the query set
    own = (b.join(qids, "id", "left_semi")                                # table streamed, never shuffled
           .groupBy(F.col("id").alias("qid")).agg(F.count("*").alias("self")))
    got = truth.groupBy("qid").agg(F.count("*").alias("truth_rows"))
    zero = F.lit(0).cast("long")
    want = F.coalesce("n", zero) - F.coalesce("self", zero)
    return (queries.select("qid", F.size("qv").alias("dim")).join(sizes, "dim", "left").join(own, "qid", "left")
            .join(compared, "qid", "left").join(got, "qid", "left")
            .select("qid", F.coalesce("compared", zero).alias("scanned"), F.coalesce("truth_rows", zero).alias("truth_rows"),
                    want.alias("_want"))
            .withColumn("valid", (F.col("scanned") == F.col("_want"))
                        & (F.col("truth_rows") == F.least(F.lit(k).cast("long"), F.col("scanned"))))
            .drop("_want"))
