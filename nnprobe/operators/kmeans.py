"""k-means for the inverted file (K6) on the block kernel.

A Lloyd step is one pass over the table: the kernel finds every row's nearest
centroid, and a task keeps per list its row count, the sums of its rows'
coordinates and its farthest row.  These parts (at most lists x dim numbers a
task) are shuffled by list and added up.  The sums are integers (coordinates in
units of 2**-bits), so the result does not depend on the order in which parts
arrive: the same start gives the same centroids on any cluster.

Lists of very unequal size make searches dear.  Between steps, a list of more
than ``SPLIT`` times the mean size is split: its farthest row becomes the
centroid of one of the lists of less than 1 / ``SPLIT`` of the mean (the
smallest for the largest, and so on).  Lists without rows keep their centroid.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.functions.distance import np_normalize, searchable
from nnprobe.operators.kernel import vectors_from_arrow
from nnprobe.session import stored

SPLIT = 4
MAX_BITS = 40
PART_SCHEMA = "list_id int, n long, sums array<long>, far_distance double, far_id long, far array<float>"


def _lists_of(flat: np.ndarray, rows: int):
    width = flat.shape[1] if rows else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(flat.reshape(-1)))


def _batch(parts: dict):
    """One batch of (list_id -> [n, sums, distance, id, vector])."""
    at = sorted(parts)
    n = len(at)
    col = lambda i, t: pa.array([parts[k][i] for k in at], t)
    sums, far = (_lists_of(np.stack([parts[k][i] for k in at]) if n else np.zeros((0, 0), t), n) for i, t in ((1, np.int64), (4, np.float32)))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), col(0, pa.int64()), sums, col(2, pa.float64()), col(3, pa.int64()), far],
                                      names=["list_id", "n", "sums", "far_distance", "far_id", "far"])


def _fold(parts: dict, k: int, n: int, sums: np.ndarray, d: float, i: int, v: np.ndarray) -> None:
    had = parts.get(k)
    if had is None:
        parts[k] = [n, sums, d, i, v]
        return
    had[0] += n
    had[1] = had[1] + sums
    if (-d, i) < (-had[2], had[3]):
        had[2:] = [d, i, v]


def _sums_of_rows(dim: int, bits: int, normalize_rows: bool):
    """mapInArrow over (id, list_id, list_distance, v): a task's part of every list."""
    def run(batches):
        parts: dict = {}
        for batch in batches:
            at, x = vectors_from_arrow(batch.column("v"), dim)
            if not len(at):
                continue
            x = np_normalize(x) if normalize_rows else x
            lists, d, ids = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("list_id", "list_distance", "id"))
            order = np.lexsort((ids, -d, lists))           # the farthest row of a list first
            starts = np.r_[0, np.nonzero(np.diff(lists[order]))[0] + 1]
            whole = np.floor(x[order].astype(np.float64) * 2.0 ** bits + 0.5).astype(np.int64)
            sums, counts = np.add.reduceat(whole, starts, axis=0), np.diff(np.r_[starts, len(order)])
            for s, total, n in zip(starts, sums, counts, strict=True):
                row = order[s]
                _fold(parts, int(lists[row]), int(n), total, float(d[row]), int(ids[row]), x[row].astype(np.float32))
        if parts:
            yield _batch(parts)

    return run


def _sums_of_parts(batches):
    """mapInArrow over the parts of a task's lists: one row a list."""
    parts: dict = {}
    for batch in batches:
        k, n, d, i = (batch.column(c).to_pylist() for c in ("list_id", "n", "far_distance", "far_id"))
        for j in range(batch.num_rows):
            _fold(parts, k[j], n[j], batch.column("sums")[j].values.to_numpy(), d[j], i[j], batch.column("far")[j].values.to_numpy())
    if parts:
        yield _batch(parts)


def sum_bits(rows: int, largest: float) -> int:
    """Binary places for which the sums of ``rows`` coordinates fit into 63 bits."""
    return min(MAX_BITS, 62 - math.ceil(math.log2(max(rows, 1) * max(largest, 1e-30))))


def lloyd_step(assigned: DataFrame, centroids: DataFrame, dim: int, bits: int, normalize_rows: bool, split: bool) -> DataFrame:
    """The next (list_id, c) from the assignment (id, list_id, list_distance, v)."""
    parts = assigned.mapInArrow(_sums_of_rows(dim, bits, normalize_rows), PART_SCHEMA)
    sums = parts.repartition("list_id").mapInArrow(_sums_of_parts, PART_SCHEMA)
    mean = F.transform("sums", lambda s: (s.cast("double") / (F.col("n") * F.lit(2.0 ** bits))).cast("float"))
    # one row a list from here on
    moved = centroids.join(sums, "list_id", "left").select(
        "list_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(mean, F.col("c")).alias("c"), "far")
    if not split:
        return moved.select("list_id", "c")
    moved = moved.withColumn("_mean", F.avg("n").over(Window.partitionBy(F.lit(0))))
    large = (moved.where(F.col("n") > SPLIT * F.col("_mean"))
             .select(F.row_number().over(Window.orderBy(F.col("n").desc(), "list_id")).alias("_j"), F.col("far").alias("_far")))
    small = (moved.where(F.col("n") < F.col("_mean") / SPLIT)
             .select(F.row_number().over(Window.orderBy("n", "list_id")).alias("_j"), "list_id"))
    taken = small.join(large, "_j").select("list_id", "_far")
    return moved.join(taken, "list_id", "left").select("list_id", F.coalesce("_far", "c").alias("c"))


def lloyd(base: DataFrame, start: DataFrame, assign, metric: str, id_col: str = "id", vec_col: str = "embedding",
          max_iter: int = 20, bits: int | None = None) -> DataFrame:
    """Centroids (list_id, c) after ``max_iter`` steps from ``start``, or sooner
    if a step changes none; stored, ``lists`` rows.  ``assign`` gives
    (id, list_id, list_distance, v) of all searchable rows.

    A step ends in a stored table, not in a checkpoint: a checkpoint keeps the
    size estimate of the plan it cuts, a product over the joins, whose digits
    multiply with every step."""
    normalized = metric in ("cosine", "ip")
    dim = int(start.agg(F.max(F.size("c"))).first()[0] or 0)
    if bits is None:
        rows = base.where(searchable(vec_col))
        top = F.lit(1.0) if normalized else F.array_max(F.transform(vec_col, lambda x: F.abs(x.cast("double"))))
        found = rows.agg(F.count("*"), F.max(top)).first()
        bits = sum_bits(found[0], float(found[1] or 1.0))
    cents = start
    for i in range(max_iter):
        moved, _ = stored(lloyd_step(assign(base, cents, metric, id_col, vec_col, carry=True), cents, dim, bits, normalized,
                                     i < max_iter - 1), "lloyd")
        same = moved.join(cents.withColumnRenamed("c", "_was"), "list_id").where(F.col("c") != F.col("_was")).isEmpty()
        cents = moved
        if same:
            break
    return cents
