"""Inverted-file index (K6-K8).

Build: centroids (``sample``: the first ``lists`` vectors in md5 order,
reproducible in SQL; ``kmeans``: Lloyd steps over all rows, ``kmeans``),
every row assigned to its nearest centroid by the block kernel, and the
table written partitioned by ``list_id`` into the shared folder.

Search at effort ``nprobe``: centroids ranked per query; the kernel of exact
search multiplies the rows of a list with only the queries that probe it, so
the work falls with the effort; the scan of the index table is pruned to the
lists that any query probes.  With ``nprobe = lists`` the result equals exact
search.

For cosine and ip, training, assignment and probing use V5-normalised
vectors under l2; candidates are always re-ranked with the true metric.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.functions.distance import check_metric, normalize, searchable
from nnprobe.operators.kernel import (ASSIGN_CARRY_SCHEMA, ASSIGN_SCHEMA, TOPK_SCHEMA, nearest_centroid, nearest_centroids,
                                      topk_per_block, topk_per_partition)
from nnprobe.operators import knn
from nnprobe.operators.kmeans import lloyd
from nnprobe.operators.knn import _base, query_matrix, rank_topk
from nnprobe.operators.sampling import DEFAULT_SEED, sample_key, smallest_by_key
from nnprobe.session import scratch_path, stored

# Fixed limits.
MAX_CENTROID_BYTES = 256 * 1024 * 1024
MAX_BROADCAST_LISTS = 1_000_000      # rows of 20 bytes
BLOCK_ROWS = 1 << 16                 # rows of a list that one block of a list-wise search holds
BLOCK_QUERIES = 1 << 12              # queries that meet them, the part that a task keeps


def default_lists(rows: int) -> int:
    return max(1, int(math.isqrt(max(rows, 1))))


def _prepared(v, metric: str):
    return normalize(v) if metric in ("cosine", "ip") else v


def train_sample(base: DataFrame, lists: int, metric: str = "cosine", seed: int = DEFAULT_SEED,
                 id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Centroids = the first ``lists`` vectors in md5(seed:train:id) order.
    The salt keeps them independent of the query sample (md5(seed:id)), so
    no query coincides with a centroid by construction."""
    check_metric(metric)
    b = _base(base, id_col, vec_col)
    keyed = b.select("id", "v", sample_key("id", seed, "train").alias("_k"))
    # pick the rows first, then prepare only those `lists` vectors
    top = smallest_by_key(keyed, "_k", lists, "id", base.count).select(
        "id", _prepared(F.col("v"), metric).alias("c"), "_k")
    cents = top.select((F.row_number().over(Window.orderBy("_k", "id")) - 1).cast("int").alias("list_id"), "c")
    return cents.checkpoint(eager=True)      # `lists` rows: later uses never rescan the table


def train_kmeans(base: DataFrame, lists: int, metric: str = "cosine", seed: int = DEFAULT_SEED,
                 id_col: str = "id", vec_col: str = "embedding", max_iter: int = 20) -> DataFrame:
    """k-means over all searchable rows from the centroids of ``train_sample``:
    Lloyd steps on the block kernel (``kmeans``)."""
    check_metric(metric)
    rows = base.where(searchable(vec_col))
    start = train_sample(rows, lists, metric, seed, id_col, vec_col)
    return lloyd(rows, start, assign, metric, id_col, vec_col, max_iter)


def centroid_matrix(centroids: DataFrame):
    tbl = centroids.select("list_id", "c").orderBy("list_id").toArrow()
    lid = tbl.column("list_id").to_numpy().astype(np.int64)
    arr = tbl.column("c").combine_chunks()
    dim = int(arr.value_lengths().to_numpy()[0]) if len(lid) else 0
    mat = arr.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lid), dim)
    return lid, mat, dim


def centroid_slices(centroids: DataFrame, max_bytes: int | None = None) -> list[DataFrame]:
    """Slices of the centroid set, each at most ``max_bytes`` as a float64
    matrix, by ranges of list_id (one slice when the whole set fits)."""
    max_bytes = max_bytes or MAX_CENTROID_BYTES
    st = centroids.agg(F.count("*").alias("n"), F.max(F.size("c")).alias("dim"),
                       F.min("list_id").alias("lo"), F.max("list_id").alias("hi")).first()
    per = max(1, max_bytes // max(int(st["dim"] or 0) * 4, 1))
    if not st["n"] or st["n"] <= per:
        return [centroids]
    return [centroids.where((F.col("list_id") >= a) & (F.col("list_id") < a + per))
            for a in range(int(st["lo"]), int(st["hi"]) + 1, per)]


def assign(base: DataFrame, centroids: DataFrame, metric: str = "cosine",
           id_col: str = "id", vec_col: str = "embedding", carry: bool = False) -> DataFrame:
    """Every row's nearest centroid: (id, list_id, list_distance), plus the
    stored vector ``v`` when ``carry`` (for writing the index in one pass).

    Slices of the centroid matrix of at most MAX_CENTROID_BYTES are broadcast
    one after another; the rows pass through one kernel per slice within the
    same task and carry their best list so far, so nothing is shuffled and
    rows that share an id stay apart."""
    sc = base.sparkSession.sparkContext
    rows = _base(base, id_col, vec_col).select("id", "v")
    norm_rows = metric in ("cosine", "ip")           # V5 applied inside the kernel
    slices = centroid_slices(centroids)
    for at, part in enumerate(slices):
        lid, mat, dim = centroid_matrix(part)
        bc = sc.broadcast({"list_id": lid, "mat": mat})
        keep = carry or at < len(slices) - 1
        fn = nearest_centroid(bc, dim, "id", "v", carry_col="v" if keep else None, normalize_rows=norm_rows, so_far=at > 0)
        rows = rows.mapInArrow(fn, ASSIGN_CARRY_SCHEMA if keep else ASSIGN_SCHEMA)
    return rows


@dataclass
class IvfIndex:
    path: str
    centroids_path: str
    metric: str
    lists: int
    centroids: DataFrame

    def manifest(self, spark, table: str, column: str, name: str | None = None) -> DataFrame:
        """P5 manifest row: what ``index_lookup`` finds and ``open_index`` opens."""
        from nnprobe.operators.profile import stored_size
        size = stored_size(self.table(spark)).select("table_size_bytes")
        opclass = {"cosine": "vector_cosine_ops", "l2": "vector_l2_ops", "ip": "vector_ip_ops"}[self.metric]
        name = name or f"{table}_{column}_ivf"
        return size.select(
            F.lit(name).alias("index_name"), F.lit("ivfflat").alias("kind"), F.lit(table).alias("table"),
            F.array(F.lit(column)).alias("columns"), F.lit(self.metric).alias("metric"),
            F.lit(self.lists).cast("int").alias("lists"), F.col("table_size_bytes").alias("size_bytes"),
            F.current_timestamp().alias("created_at"),
            F.lit(f"USING ivfflat ({column} {opclass}) WITH (lists='{self.lists}')").alias("definition"),
            F.lit(self.path).alias("path"), F.lit(self.centroids_path).alias("centroids_path"))

    def table(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)


def open_index(spark, found) -> IvfIndex:
    """The index a manifest row (of any session) points to."""
    if not found["path"]:
        raise ValueError("no stored index was found")
    return IvfIndex(path=found["path"], centroids_path=found["centroids_path"], metric=found["metric"],
                    lists=int(found["lists"]), centroids=spark.read.parquet(found["centroids_path"]))


def build_index(base: DataFrame, centroids: DataFrame, metric: str = "cosine",
                id_col: str = "id", vec_col: str = "embedding", path: str | None = None) -> IvfIndex:
    """Assign and write (id, v, list_id) partitioned by list_id to the shared folder.

    The written table is also the lineage cut: later stages read it back.
    """
    spark = base.sparkSession
    # one kernel pass assigns and carries the stored vector: no join back
    rows = assign(base, centroids, metric, id_col, vec_col, carry=True).select("id", "v", "list_id")
    path = path or scratch_path(spark, "ivf")
    # REBALANCE on list_id: few files per list, and AQE splits a list that
    # holds a large share of the rows over several writer tasks (no sampling
    # pass, unlike range partitioning, which would rerun the kernel)
    rows.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
    kept, cents = stored(centroids, "centroids")
    return IvfIndex(path=path, centroids_path=cents, metric=metric, lists=kept.count(), centroids=kept)


def probe_ranks(queries: DataFrame, centroids: DataFrame, metric: str = "cosine",
                depth: int | None = None) -> DataFrame:
    """(qid, list_id, probe_rank): the ``depth`` nearest centroids of every
    query by (l2 on prepared vectors, list_id); all lists when depth is None.

    Runs the block kernel with the centroids as the scanned side and the
    prepared queries broadcast, so it scales with lists x queries."""
    q = queries.select("pos", "qid", _prepared(F.col("qv"), metric).alias("qv"))
    c = centroids.select(F.col("list_id").cast("long").alias("id"), F.col("c").alias("embedding"))
    k = depth if depth is not None else centroids.count()
    r = knn.exact_knn(c, q, max(1, int(k)), "l2", exclude_self=False, strategy="block")
    return r.select("qid", F.col("id").cast("int").alias("list_id"), F.col("rank").alias("probe_rank"))


def probe_scan(spark, index: IvfIndex, queries: DataFrame, k: int, nprobe: int,
               exclude_self: bool = True) -> DataFrame:
    """The kernel's rows: candidates, and per task and query the rows compared."""
    # queries x nprobe rows, read once per slice and for pruning
    probes = probe_ranks(queries, index.centroids, index.metric, depth=nprobe).checkpoint(eager=True)
    # only the folders of probed lists are read: the distinct lists prune the
    # scan's partitions at run time (Spark plans that for a filtered side only)
    probed = F.broadcast(probes.where(F.col("list_id") >= 0).select("list_id").distinct())       # at most one row per list
    tbl = index.table(spark).join(probed, "list_id", "left_semi").select("id", "v", "list_id")
    sc = spark.sparkContext
    cand = None
    for chunk in knn.query_chunks(queries, extra=8 * nprobe):
        qid, mat, dim = query_matrix(chunk)
        # the probes of this slice: at most slice x nprobe rows, bounded like the slice
        pt = probes.join(F.broadcast(chunk.select("qid")), "qid", "left_semi").select("qid", "list_id").toArrow()
        lists = pt.column("list_id").to_numpy().astype(np.int64)
        order = np.argsort(qid)
        at = order[np.searchsorted(qid[order], pt.column("qid").to_numpy())]
        by = np.argsort(lists, kind="stable")
        offsets = np.searchsorted(lists[by], np.arange(index.lists + 1))
        bc = sc.broadcast({"qid": qid, "mat": mat, "members": at[by].astype(np.int32), "offsets": offsets})
        fn = topk_per_partition(bc, index.metric, k, exclude_self, dim, "id", "v", list_col="list_id")
        part = tbl.mapInArrow(fn, TOPK_SCHEMA)
        cand = part if cand is None else cand.unionByName(part)
    return cand


def probe_table(queries: DataFrame, centroids: DataFrame, metric: str, depth: int) -> DataFrame:
    """(qid, list_id, probe_rank) as ``probe_ranks`` gives them, with the queries
    as the scanned side: slices of the centroids are broadcast, the query set,
    of any size, never leaves the executors."""
    sc = queries.sparkSession.sparkContext
    rows = queries.select(F.col("qid").cast("long").alias("qid"), "qv")
    cand = None
    for part in centroid_slices(centroids):
        lid, mat, dim = centroid_matrix(part)
        fn = nearest_centroids(sc.broadcast({"list_id": lid, "mat": mat}), dim, depth, metric in ("cosine", "ip"))
        near = rows.mapInArrow(fn, "qid long, id long, distance double")
        cand = near if cand is None else cand.unionByName(near)
    return rank_topk(cand, depth).select("qid", F.col("id").cast("int").alias("list_id"), F.col("rank").alias("probe_rank"))


def list_scan(spark, index: IvfIndex, queries: DataFrame, k: int, nprobe: int, exclude_self: bool = True,
              block_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """The rows of ``probe_scan`` by a shuffle: the queries of a list meet its
    rows where both are sent.  The index is read once, whatever the number of
    queries, and nothing but the lists' figures is broadcast.

    A list of many rows or queries is dealt over blocks of at most about
    ``block_rows`` x ``block_queries``: each row goes to every block of queries
    of its list and each query to every block of rows."""
    dims = queries.agg(F.min(F.size("qv")), F.max(F.size("qv")), F.count_if(F.col("qv").isNull())).first()
    if dims[2] or dims[0] != dims[1]:
        raise ValueError("query vectors must be non-NULL and of one dimension")
    probes, _ = stored(probe_table(queries, index.centroids, index.metric, nprobe), "probes")
    tbl = index.table(spark)
    asked = probes.groupBy("list_id").agg(F.count("*").alias("q"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    plan, _ = stored(asked.join(list_sizes(tbl), "list_id").select(
        "list_id", blocks("list_size", block_rows or BLOCK_ROWS).alias("rs"), blocks("q", block_queries or BLOCK_QUERIES).alias("qs")), "list-plan")
    few = plan.count() <= MAX_BROADCAST_LISTS
    plan = plan.where("list_id >= 0")                # a condition lets Spark prune the index's partitions by the lists
    plan = F.broadcast(plan) if few else plan

    def dealt(df, own, n_own, n_other, is_row):
        own_block = F.pmod(F.xxhash64(own), F.col(n_own)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        df = df.select("list_id", own_block.alias("a"), other.alias("b"), F.lit(is_row).alias("is_row"), F.col(own).alias("id"), "v")
        return df.withColumnsRenamed({"a": "r", "b": "q"} if is_row else {"a": "q", "b": "r"}).select(
            "list_id", "r", "q", "is_row", "id", "v")

    rows = dealt(tbl.join(plan, "list_id"), "id", "rs", "qs", True)
    asks = probes.join(queries.select(F.col("qid").cast("long").alias("qid"), F.col("qv").alias("v")), "qid").join(plan, "list_id")
    both = rows.unionAll(dealt(asks, "qid", "qs", "rs", False))
    both = both.repartition("list_id", "r", "q").sortWithinPartitions("list_id", "r", "q", "is_row")
    return both.mapInArrow(topk_per_block(index.metric, k, exclude_self, int(dims[1] or 0)), TOPK_SCHEMA)


def search(spark, index: IvfIndex, queries: DataFrame, k: int, nprobe: int,
           exclude_self: bool = True, strategy: str | None = None) -> DataFrame:
    """K7: approximate top-k at effort nprobe; may return fewer than k rows.

    ``broadcast`` ships the query set to the index's rows, ``lists`` sends both
    to the lists (``list_scan``); by default the first while the set is one
    slice.  Both compare the same rows and give the same result."""
    if strategy is None:
        strategy = "broadcast" if len(knn.query_chunks(queries, extra=8 * nprobe)) == 1 else "lists"
    if strategy not in ("broadcast", "lists"):
        raise ValueError(f"unknown strategy {strategy!r}")
    scan = probe_scan if strategy == "broadcast" else list_scan
    return rank_topk(scan(spark, index, queries, k, nprobe, exclude_self).where(F.col("id").isNotNull()), k)


def assignment_table(base: DataFrame, centroids: DataFrame, metric: str = "cosine",
                     id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The assignment written once to the shared folder and read back: one
    kernel pass over the table serves every later use, and the written
    table cuts the lineage."""
    return stored(assign(base, centroids, metric, id_col, vec_col).select("id", "list_id"), "assign")[0]


def list_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("list_id").agg(F.count("*").alias("list_size"))


def scan_cost(probes: DataFrame, sizes: DataFrame, efforts: DataFrame) -> DataFrame:
    """K8: candidates compared per query at each effort = sum of the sizes of
    the probed lists.  ``efforts``: (sweep_idx, effort), a short parameter list.

    Running sum over probe ranks per query, then an equi join on the rank
    that each effort stops at (efforts above the list count stop at the last).
    """
    n_lists = probes.groupBy("qid").agg(F.max("probe_rank").alias("n_lists"))
    w = Window.partitionBy("qid").orderBy("probe_rank").rowsBetween(Window.unboundedPreceding, 0)
    cum = (probes.join(sizes, "list_id", "left")
           .select("qid", "probe_rank",
                   F.sum(F.coalesce("list_size", F.lit(0))).over(w).alias("scanned")))
    stop = (n_lists.crossJoin(F.broadcast(efforts))
            .select("qid", "sweep_idx", "effort",
                    F.least(F.col("effort"), F.col("n_lists")).alias("probe_rank")))
    return (stop.join(cum, ["qid", "probe_rank"])
            .select("qid", "sweep_idx", "effort", F.col("scanned").cast("long").alias("scanned")))
