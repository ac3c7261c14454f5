"""Recall evaluation of an inverted-file index (the core question).

"For n sampled queries, what is recall@k of an inverted file with L lists at
each effort, and how many rows does each effort compare?"

One logical plan: sample -> exact truth (block kernel, whole table) ->
centroids -> assignment -> probe ranks -> shortcut sweep.  Queries and
centroids are bounded by parameters and broadcast; the table is scanned
twice (truth, assignment) and never shuffled with its vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.operators import ivf, knn, recall, sampling


@dataclass
class EvalConfig:
    metric: str = "cosine"
    k: int = 10
    queries: int = 50
    recall_sample: int | None = None     # W4: None: all drawn queries
    lists: int | None = None       # None: the square root of the row count
    efforts: tuple = (1, 2, 4, 8, 16)
    trainer: str = "sample"
    kmeans_steps: int = 20
    seed: int = sampling.DEFAULT_SEED
    strategy: str = "block"


@dataclass
class EvalParts:
    queries: DataFrame
    truth: DataFrame
    centroids: DataFrame
    assignment: DataFrame
    probes: DataFrame
    efforts: DataFrame
    per_query: DataFrame
    cost: DataFrame
    points: DataFrame


def evaluate(base: DataFrame, cfg: EvalConfig = EvalConfig(), id_col: str = "id",
             vec_col: str = "embedding") -> EvalParts:
    spark = base.sparkSession
    _, q = sampling.draw_queries(base, cfg.queries, cfg.recall_sample or cfg.queries, id_col, vec_col, cfg.seed)
    lists = cfg.lists or ivf.default_lists(base.count())
    truth = knn.exact_knn(base, q, cfg.k, cfg.metric, exclude_self=True,
                          strategy=cfg.strategy, id_col=id_col, vec_col=vec_col)
    if cfg.trainer == "sample":
        cents = ivf.train_sample(base, lists, cfg.metric, cfg.seed, id_col, vec_col)
    elif cfg.trainer == "kmeans":
        cents = ivf.train_kmeans(base, lists, cfg.metric, cfg.seed, id_col, vec_col, cfg.kmeans_steps)
    else:
        raise ValueError(f"unknown trainer {cfg.trainer!r}")
    asg = ivf.assignment_table(base, cents, cfg.metric, id_col, vec_col)
    # queries x max(effort) rows, bounded: written once, read by sweep and cost
    probes = ivf.probe_ranks(q, cents, cfg.metric, depth=max(cfg.efforts)).checkpoint(eager=True)
    eff = recall.efforts_frame(spark, cfg.efforts)
    per = recall.sweep(truth, asg, probes, q, eff, truth_rows=(cfg.recall_sample or cfg.queries) * cfg.k)
    cost = ivf.scan_cost(probes, ivf.list_sizes(asg), eff)
    pts = recall.sweep_points(per, cost)
    return EvalParts(q, truth, cents, asg, probes, eff, per, cost, pts)


def recall_sweep(base: DataFrame, cfg: EvalConfig = EvalConfig(), id_col: str = "id",
                 vec_col: str = "embedding") -> DataFrame:
    """(sweep_idx, nprobe, recall, scanned_per_query), doubles rounded to 6."""
    p = evaluate(base, cfg, id_col, vec_col).points
    return p.select("sweep_idx", F.col("effort").alias("nprobe"),
                    F.round("recall", 6).alias("recall"),
                    F.round("scanned_per_query", 6).alias("scanned_per_query"))
