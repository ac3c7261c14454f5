"""Nearest measured reference for a workload shape.

A nearest-neighbour join with refusal: every workload is compared with the
reference buckets of the same index kind (any kind when the workload's is
empty); the least shape distance wins, the first bucket on ties; above the
tolerance the workload keeps its row with ``found = false``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nnprobe.functions.text import rows_bucket

# Fixed tolerance of the projection.
MAX_NORM = 0.5
# Buckets are broadcast only while the set is this small (checked).
MAX_BROADCAST_BUCKETS = 100_000


def rel_diff(a, b) -> Column:
    """|a-b| / max(|a|,|b|), 0 when both are 0."""
    a = (F.col(a) if isinstance(a, str) else a).cast("double")
    b = (F.col(b) if isinstance(b, str) else b).cast("double")
    den = F.greatest(F.abs(a), F.abs(b))
    return F.when(den == 0, F.lit(0.0)).otherwise(F.abs(a - b) / den)


def shape_distance(w_dim, w_rows, w_eff, b_dim, b_rows, b_eff) -> Column:
    """(rd(dim) + rd(rows) + [rd(effort) if both > 0]) / 3, always / 3."""
    eff = F.when((w_eff > 0) & (b_eff > 0), rel_diff(b_eff, w_eff)).otherwise(F.lit(0.0))
    return (rel_diff(b_dim, w_dim) + rel_diff(b_rows, w_rows) + eff) / 3.0


def nearest_reference(workloads: DataFrame, buckets: DataFrame, max_norm: float = MAX_NORM,
                      n_buckets: int | None = None) -> DataFrame:
    """J3.  workloads: (workload_id, dim, rows, index, ef_search);
    buckets: (bucket_pos, dim, rows, index, ef_search, ...).
    Returns (workload_id, found, bucket_pos, distance_norm)."""
    b = buckets.select(*[F.col(c).alias(f"b_{c}") for c in buckets.columns])
    if n_buckets is None:
        n_buckets = buckets.limit(MAX_BROADCAST_BUCKETS + 1).count()
    if n_buckets <= MAX_BROADCAST_BUCKETS:
        b = F.broadcast(b)
    w = workloads
    # a workload with an index kind meets only buckets of that kind (equi
    # join); one without a kind meets every bucket (the bounded set)
    any_kind = F.coalesce(F.col("index"), F.lit("")) == ""
    pairs = (w.where(~any_kind).join(b, F.col("b_index") == F.col("index"), "inner")
             .unionByName(w.where(any_kind).crossJoin(b)))
    cand = pairs.withColumn("d", shape_distance(F.col("dim"), F.col("rows"), F.col("ef_search"),
                                                F.col("b_dim"), F.col("b_rows"), F.col("b_ef_search")))
    # least distance, first bucket on ties: a min over (d, bucket_pos) with
    # map-side partial aggregation, no sort of all candidate pairs
    best = (cand.groupBy("workload_id").agg(F.min(F.struct("d", "b_bucket_pos")).alias("_b"))
            .where(F.col("_b.d") <= max_norm)
            .select("workload_id", F.col("_b.b_bucket_pos").alias("bucket_pos"), F.col("_b.d").alias("distance_norm")))
    return (w.select("workload_id").join(best, "workload_id", "left")
            .select("workload_id", F.col("bucket_pos").isNotNull().alias("found"), "bucket_pos", "distance_norm"))


def effort_for_projection(default_point_effort, index_default) -> Column:
    """The default recall point's effort, else the index default, else 0."""
    return F.coalesce(F.nullif(default_point_effort, F.lit(0)), F.nullif(index_default, F.lit(0)), F.lit(0))


def comparison_rows(measured: DataFrame, projected: DataFrame | None = None) -> DataFrame:
    """(metric, measured, projected) rows for p50, p95, peak QPS and
    recall@k.  ``measured``: one row (p50_ms, p95_ms, peak_qps, recall,
    effort); measured recall only when effort > 0.  ``projected``: one row
    (p50_ms, p95_ms, qps, recall) or None (right side NULL)."""
    m = measured.select(F.col("p50_ms").alias("m_p50"), F.col("p95_ms").alias("m_p95"),
                        F.col("peak_qps").alias("m_qps"),
                        F.when(F.col("effort") > 0, F.col("recall")).alias("m_recall"))
    if projected is not None:
        p = projected.select(F.col("p50_ms").alias("p_p50"), F.col("p95_ms").alias("p_p95"),
                             F.col("qps").alias("p_qps"), F.col("recall").alias("p_recall"))
        m = m.crossJoin(p)       # one row each
    else:
        m = m.select("*", *[F.lit(None).cast("double").alias(c) for c in ("p_p50", "p_p95", "p_qps", "p_recall")])
    return m.selectExpr("stack(4, 'p50_ms', m_p50, p_p50, 'p95_ms', m_p95, p_p95, "
                        "'peak_qps', m_qps, p_qps, 'recall', m_recall, p_recall) AS (metric, measured, projected)")


def shape_row(dim, rows, metric, p95_ms, qps, recall, index_kind) -> list[Column]:
    """The shareable aggregate row; never names, hosts or vectors."""
    return [F.col(dim).cast("int").alias("dims") if isinstance(dim, str) else dim.alias("dims"),
            rows_bucket(rows).alias("rows_bucket"),
            (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
            F.format_string("%.1f", p95_ms).alias("p95"),
            F.format_string("%.0f", F.bround(qps, 0)).alias("qps"),
            F.format_string("%.3f", recall).alias("recall"),
            (F.lit(index_kind) if isinstance(index_kind, str) else index_kind).alias("index")]
