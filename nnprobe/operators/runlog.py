"""Times of the library's own runs.

A ``RunLog`` runs stages of work and notes for each when it started and ended,
how many queries it answered and what Spark observed while it ran; the notes
are measurement rows like any other, so the sink, the summaries and the sweep
read them.  A search is timed in batches of queries: a query's duration is its
share of its batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nnprobe.operators import ivf, knn
from nnprobe.operators.knn import rank_topk
from nnprobe.session import stored

LOG_SCHEMA = ("phase string, level string, worker long, seq long, ended_us long, started_us long, dur_ms double, run_id string, "
              "sweep_idx int, effort int, queries long, compared long, found long")
BATCH = 100            # queries answered by one timed search


class RunLog:
    """Notes of one run, a row per stage or batch: bounded by what the caller runs."""

    def __init__(self, run_id: str):
        self.run_id, self.notes = run_id, []

    def stage(self, phase: str, work: Callable, level: str = "", queries: int = 1, sweep_idx: int | None = None,
              effort: int | None = None, figures: Callable | None = None):
        """Run ``work`` and note it; ``figures`` gives (compared, found) afterwards."""
        started, t0 = int(time.time() * 1e6), time.perf_counter()
        got = work()
        taken = time.perf_counter() - t0
        compared, found = figures(got) if figures else (None, None)
        self.notes.append((phase, level, 0, len(self.notes), started + max(1, int(taken * 1e6)), started, taken * 1000 / max(queries, 1),
                           self.run_id, sweep_idx, effort, queries, compared, found))
        return got

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.notes, LOG_SCHEMA)


def timed_sweep(log: RunLog, index: ivf.IvfIndex, queries: DataFrame, k: int, efforts, exclude_self: bool = True,
                batch: int = BATCH) -> DataFrame:
    """Search every query at every effort, in batches of ``batch`` by
    ``pos``, noted in ``log`` with the rows compared and found; returns
    (sweep_idx, effort, qid, rank, id, distance)."""
    spark = queries.sparkSession
    span = queries.agg(F.min("pos"), F.max("pos")).first()
    out = None
    for at, effort in enumerate(efforts):
        for lo in range(span[0], span[1] + 1, batch) if span[0] is not None else ():
            some = queries.where((F.col("pos") >= lo) & (F.col("pos") < lo + batch))
            seen, ranked = Observation(), Observation()

            def work():
                scan = ivf.probe_scan(spark, index, some, k, effort, exclude_self).observe(
                    seen, F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
                top = rank_topk(scan.where(F.col("id").isNotNull()), k).observe(ranked, F.count(F.lit(1)).alias("found"))
                return stored(top, "timed-search")[0]

            part = log.stage("search", work, str(effort), some.count(), at, int(effort),
                             lambda _: (seen.get["compared"], ranked.get["found"]))          # noqa: B023
            part = part.select(F.lit(at).alias("sweep_idx"), F.lit(int(effort)).alias("effort"), *part.columns)
            out = part if out is None else out.unionByName(part)
    return out


def timed_evaluation(spark: SparkSession, base: DataFrame, queries: DataFrame, k: int, lists: int, efforts, run_id: str,
                     metric: str = "cosine", exclude_self: bool = True) -> tuple[RunLog, DataFrame, DataFrame]:
    """(log, found, truth): index build, exact truth and the sweep, each timed."""
    log = RunLog(run_id)
    index = log.stage("build", lambda: ivf.build_index(base, ivf.train_sample(base, lists, metric), metric))
    truth = log.stage("truth", lambda: stored(knn.exact_knn(base, queries, k, metric, exclude_self=exclude_self), "truth")[0],
                      queries=queries.count())
    return log, timed_sweep(log, index, queries, k, efforts, exclude_self), truth
