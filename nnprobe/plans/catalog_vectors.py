"""Registered queries over ``embeddings``.

Each entry is (spark_fn, oracle_sql_or_None).  Every query reads the whole
table; the only limits are the features themselves (n sampled queries,
top-k, lists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.functions import distance as D
from nnprobe.functions.vectext import parse, render
from nnprobe.operators import ivf, knn, profile, recall, sampling
from nnprobe.operators.kmeans import SPLIT
from nnprobe.plans import sqlparts as S
from nnprobe.plans.evaluation import EvalConfig, evaluate
from nnprobe.session import scratch_path, table
from nnprobe.sources.synthetic import vectors_for_ids

# Fixed parameters of the registered queries.
SEED = 42
N_QUERIES = 200      # the reference's default recall sample
K = 10
LISTS = 16
EFFORTS = (1, 2, 4, 8, 16)
NPROBE = 4
DEFAULT_EFFORT = 4


def base(spark, sf: str, scaled: bool = False) -> DataFrame:
    """(id, embedding); ``scaled`` multiplies row i by 1 + (i mod 7)/2 so the
    three metrics rank differently (the raw table is unit norm)."""
    e = table(spark, sf, "embeddings")
    if scaled:
        f = F.lit(1.0) + (F.col("vec_id") % 7) / 2.0
        return e.select(F.col("vec_id").alias("id"),
                        F.transform("embedding", lambda x: (x * f).cast("float")).alias("embedding"))
    return e.select(F.col("vec_id").alias("id"), "embedding")


def _queries(spark, sf, scaled=False, n=N_QUERIES):
    return sampling.sample_queries(base(spark, sf, scaled), n, seed=SEED)


def _r6(c):
    return F.round(c, 6)


# --- V1-V5 -------------------------------------------------------------------

def _pairs(spark, sf):
    """Per row: a = the scaled vector, b = the raw vector reversed.  A
    row-local pairing: the distances are computed where the row is read,
    with no join and no shuffle of the vectors."""
    e = table(spark, sf, "embeddings")
    f = F.lit(1.0) + (F.col("vec_id") % 7) / 2.0
    return e.select(F.col("vec_id").alias("id"),
                    F.transform("embedding", lambda x: (x * f).cast("float")).alias("a"),
                    F.reverse("embedding").alias("b"))


def _vec_metric(metric):
    def run(spark, sf):
        return _pairs(spark, sf).select("id", _r6(D.distance(metric, "a", "b")).alias("distance"))

    sql = f"""WITH src AS ({S.src_embeddings(True)}),
p AS (SELECT s.id, s.v AS a, list_reverse(e.embedding) AS b FROM src s JOIN embeddings e ON e.vec_id = s.id)
SELECT id, round({S.dist(metric, 'a', 'b')}, 6) AS distance FROM p"""
    return run, sql


def q_vec_normalize(spark, sf):
    b = base(spark, sf, scaled=True)
    nv = D.normalize("embedding")
    return b.select("id", nv.alias("n"), D.norm("embedding").alias("nb")).select(
        "id", _r6(F.col("nb")).alias("norm_before"),
        _r6(F.aggregate("n", F.lit(0.0), lambda acc, x: acc + x.cast("double"))).alias("coord_sum"),
        _r6(D.norm("n")).alias("norm_after"))


SQL_VEC_NORMALIZE = f"""WITH src AS ({S.src_embeddings(True)}),
n AS (SELECT id, v, {S.normalized('v')} AS nv FROM src)
SELECT id, round(sqrt({S.sqnorm('v')}), 6) AS norm_before,
       round(list_sum(nv::DOUBLE[]), 6) AS coord_sum,
       round(sqrt({S.sqnorm('nv')}), 6) AS norm_after
FROM n"""


def q_vec_parse(spark, sf):
    b = base(spark, sf, scaled=True)
    vec, err = parse(render("embedding"))
    p = b.select("id", vec.alias("p"), err.alias("vec_error"))
    return p.select("id", F.size("p").cast("int").alias("dim"), "vec_error",
                    _r6(F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x.cast("double"))).alias("coord_sum"))


SQL_VEC_PARSE = f"""WITH src AS ({S.src_embeddings(True)}),
p AS (SELECT id, list_transform(string_split(trim(v::VARCHAR, '[] '), ','), lambda s: trim(s)::FLOAT) AS p FROM src)
SELECT id, len(p)::INTEGER AS dim, false AS vec_error, round(list_sum(p::DOUBLE[]), 6) AS coord_sum FROM p"""


# --- P1-P3, P7 ---------------------------------------------------------------

def q_profile(spark, sf):
    p = profile.profile(base(spark, sf), "id", "embedding")
    return p.select("rows", "dim_min", "dim_max", "null_vectors", "zero_norm",
                    _r6(F.col("min_norm")).alias("min_norm"), _r6(F.col("max_norm")).alias("max_norm"))


SQL_PROFILE = f"""WITH src AS ({S.src_embeddings()})
SELECT count(*) AS rows, min(len(v))::INTEGER AS dim_min, max(len(v))::INTEGER AS dim_max,
       count(*) FILTER (WHERE v IS NULL) AS null_vectors,
       count(*) FILTER (WHERE {S.sqnorm('v')} = 0) AS zero_norm,
       round(min(sqrt({S.sqnorm('v')})), 6) AS min_norm, round(max(sqrt({S.sqnorm('v')})), 6) AS max_norm
FROM src"""


def q_facts(spark, sf):
    p = profile.profile(base(spark, sf), "id", "embedding")
    return profile.facts(p, "embeddings", "embedding")


SQL_FACTS = f"""WITH src AS ({S.src_embeddings()}),
p AS (SELECT count(*) AS rows, max(len(v)) AS dim, count(*) FILTER (WHERE v IS NULL) AS nn,
             count(*) FILTER (WHERE {S.sqnorm('v')} = 0) AS zn FROM src)
SELECT 0::INTEGER AS pos, 'table' AS key, 'embeddings' AS value FROM p
UNION ALL SELECT 1, 'rows', format('{{:,}}', rows) FROM p
UNION ALL SELECT 2, 'column', 'embedding vector(' || dim::VARCHAR || ')' FROM p
UNION ALL SELECT 3, 'null_vectors', nn::VARCHAR FROM p
UNION ALL SELECT 4, 'zero_norm', zn::VARCHAR FROM p"""


# --- W1-W5 -------------------------------------------------------------------

def q_sample_queries(spark, sf):
    return _queries(spark, sf).select("pos", "qid")


SQL_SAMPLE_QUERIES = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)}
SELECT pos, qid FROM q"""


BLOCKS = 64


def q_sample_block(spark, sf):
    """W3 on the table stored in 64 blocks (threshold 0): a share of the blocks
    is read, then the usual order."""
    path = scratch_path(spark, "blocks")
    src = base(spark, sf).withColumn("block", F.pmod("id", F.lit(BLOCKS)))
    src.repartition("block").write.partitionBy("block").parquet(path)
    b = spark.read.schema("id long, embedding array<float>, block int").parquet(path)
    q = sampling.sample_queries(b, N_QUERIES, seed=SEED, rows=b.count(), threshold=0, block_pattern="block=[0-9]+")
    return q.select("pos", "qid")


def _sql_sample_block():
    # shares of the blocks, each four times the one before, until one holds enough rows
    return f"""WITH src AS ({S.src_embeddings()}),
b AS (SELECT *, 'block=' || (id % {BLOCKS})::VARCHAR AS block FROM src),
r AS (SELECT block, row_number() OVER (ORDER BY md5('{SEED}:block:' || block)) AS r, count(*) OVER () AS blocks FROM (SELECT DISTINCT block FROM b)),
pct AS (SELECT step, least(100.0, pct * power(4, step)) AS pct FROM range(8) t(step),
         (SELECT round(least(greatest({4 * N_QUERIES} / count(*) * 100, 0.1), 100.0), 4) AS pct FROM src)),
size AS (SELECT step, count(*) FILTER (WHERE v IS NOT NULL) AS n, any_value(pct) AS pct FROM pct, b JOIN r USING (block)
         WHERE r <= least(blocks, greatest(1, ceil(blocks * pct / 100))) GROUP BY step),
last AS (SELECT min(step) AS step FROM size WHERE n >= {N_QUERIES} OR pct >= 100),
s AS (SELECT id, {S.md5_key('id')} AS k FROM pct JOIN last USING (step), b JOIN r USING (block)
      WHERE v IS NOT NULL AND r <= least(blocks, greatest(1, ceil(blocks * pct / 100))) ORDER BY k, id LIMIT {N_QUERIES})
SELECT (row_number() OVER (ORDER BY k, id) - 1)::INTEGER AS pos, id AS qid FROM s"""


SQL_SAMPLE_BLOCK = _sql_sample_block()


def q_workload_expand(spark, sf):
    q = _queries(spark, sf)
    runs = table(spark, sf, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"))
    return sampling.expand(runs, q, N_QUERIES)


SQL_WORKLOAD_EXPAND = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)}
SELECT e.user_id AS worker, e.event_id AS seq, q.qid
FROM events e JOIN q ON q.pos = ((e.user_id + e.event_id) % {N_QUERIES})"""


# --- K1-K5 -------------------------------------------------------------------

def _knn(metric, scaled, exclude_self=True, strategy="block"):
    def run(spark, sf):
        b = base(spark, sf, scaled)
        q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
        r = knn.exact_knn(b, q, K, metric, exclude_self=exclude_self, strategy=strategy)
        return r.select("qid", "rank", "id", _r6(F.col("distance")).alias("distance"))

    sql = f"""WITH src AS ({S.src_embeddings(scaled)}), {S.queries_cte(N_QUERIES)},
{S.knn_cte('knn', metric, K, exclude_self)}
SELECT qid, rank, id, round(distance, 6) AS distance FROM knn"""
    return run, sql


def q_scan_audit(spark, sf):
    b = base(spark, sf)
    q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
    truth, compared = knn.audited_knn(b, q, K, "cosine")
    return knn.scan_audit(b, q, truth, compared, K)


SQL_SCAN_AUDIT = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)},
{S.knn_cte('truth', 'cosine', K)},
ok AS (SELECT id, len(v) AS dim FROM src WHERE v IS NOT NULL AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
sz AS (SELECT dim, count(*) AS n FROM ok GROUP BY dim),
got AS (SELECT qid, count(*) AS truth_rows FROM truth GROUP BY qid),
a AS (SELECT q.qid, coalesce(sz.n, 0) - (CASE WHEN ok.id IS NULL THEN 0 ELSE 1 END) AS scanned,
             coalesce(got.truth_rows, 0) AS truth_rows
      FROM q LEFT JOIN sz ON sz.dim = len(q.qv) LEFT JOIN ok ON ok.id = q.qid LEFT JOIN got ON got.qid = q.qid)
SELECT qid, scanned::BIGINT AS scanned, truth_rows::BIGINT AS truth_rows,
       truth_rows = least({K}, scanned) AS valid FROM a"""


# --- K6-K8 -------------------------------------------------------------------

def q_ivf_assign(spark, sf):
    b = base(spark, sf)
    c = ivf.train_sample(b, LISTS, "cosine", SEED)
    return ivf.assign(b, c, "cosine").select("id", "list_id", _r6(F.col("list_distance")).alias("list_distance"))


SQL_IVF_ASSIGN = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)},
{S.ivf_ctes('cosine', LISTS)}
SELECT id, list_id, round(list_distance, 6) AS list_distance FROM asg"""


def q_ivf_search(spark, sf):
    b = base(spark, sf)
    q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
    c = ivf.train_sample(b, LISTS, "cosine", SEED)
    index = ivf.build_index(b, c, "cosine")
    r = ivf.search(spark, index, q, K, NPROBE)
    return r.select("qid", "rank", "id", _r6(F.col("distance")).alias("distance"))


SQL_IVF_SEARCH = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)},
{S.ivf_ctes('cosine', LISTS)},
cand AS (SELECT s.id, s.v, asg.list_id FROM src s JOIN asg ON asg.id = s.id),
{S.knn_cte('ann', 'cosine', K, True, src='cand',
           extra_where=f'AND EXISTS (SELECT 1 FROM pr WHERE pr.qid = q.qid AND pr.list_id = b.list_id AND pr.probe_rank <= {NPROBE})')}
SELECT qid, rank, id, round(distance, 6) AS distance FROM ann"""


def q_ivf_search_all(spark, sf):
    """K7 with every row of the table as a query: queries and rows meet at the lists."""
    b = base(spark, sf)
    index = ivf.build_index(b, ivf.train_sample(b, LISTS, "cosine", SEED), "cosine")
    q = b.where(F.col("embedding").isNotNull()).select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    return ivf.search(spark, index, q, K, NPROBE, strategy="lists").select("qid", "rank", "id", _r6(F.col("distance")).alias("distance"))


SQL_IVF_SEARCH_ALL = f"""WITH src AS ({S.src_embeddings()}), q AS (SELECT id AS qid, v AS qv FROM src WHERE v IS NOT NULL),
{S.ivf_ctes('cosine', LISTS)},
cand AS MATERIALIZED (SELECT s.id, s.v, asg.list_id FROM src s JOIN asg ON asg.id = s.id),
near AS MATERIALIZED (SELECT qid, list_id FROM pr WHERE probe_rank <= {NPROBE}),
pairs AS (SELECT q.qid, b.id, {S.dist('cosine', 'q.qv', 'b.v')} AS distance
          FROM near JOIN q ON q.qid = near.qid JOIN cand b ON b.list_id = near.list_id WHERE b.id <> q.qid),
ann AS (SELECT qid, id, distance, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INTEGER AS rank FROM pairs)
SELECT qid, rank, id, round(distance, 6) AS distance FROM ann WHERE rank <= {K}"""


def q_ivf_cost(spark, sf):
    p = evaluate(base(spark, sf), _cfg())
    return p.cost.select("qid", "sweep_idx", F.col("effort").alias("nprobe"), "scanned")


def _cfg(n=N_QUERIES):
    return EvalConfig(metric="cosine", k=K, queries=n, lists=LISTS, efforts=EFFORTS, trainer="sample", seed=SEED)


_EVAL_SQL_HEAD = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)},
{S.knn_cte('truth', 'cosine', K)},
{S.ivf_ctes('cosine', LISTS)},
{S.efforts_cte(EFFORTS)},
{S.sweep_ctes('truth')}"""

SQL_IVF_COST = _EVAL_SQL_HEAD + "\nSELECT qid, sweep_idx, effort AS nprobe, scanned FROM cost"


# --- R1-R4 -------------------------------------------------------------------

def q_recall_per_query(spark, sf):
    """R1 from a real K7 search at NPROBE against exact truth."""
    b = base(spark, sf)
    q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
    truth = knn.exact_knn(b, q, K, "cosine")
    c = ivf.train_sample(b, LISTS, "cosine", SEED)
    index = ivf.build_index(b, c, "cosine")
    ann = ivf.search(spark, index, q, K, NPROBE)
    return recall.per_query(ann, truth, q).select("qid", "hits", "truth_len", _r6(F.col("recall")).alias("recall"))


SQL_RECALL_PER_QUERY = _EVAL_SQL_HEAD + f""",
cand AS (SELECT s.id, s.v, asg.list_id FROM src s JOIN asg ON asg.id = s.id),
{S.knn_cte('ann', 'cosine', K, True, src='cand',
           extra_where=f'AND EXISTS (SELECT 1 FROM pr WHERE pr.qid = q.qid AND pr.list_id = b.list_id AND pr.probe_rank <= {NPROBE})')}
SELECT q.qid, coalesce(h.hits, 0)::BIGINT AS hits, coalesce(h.tl, 0)::BIGINT AS truth_len,
       round(CASE WHEN coalesce(h.tl, 0) > 0 THEN h.hits / h.tl ELSE 0.0 END, 6) AS recall
FROM q LEFT JOIN (
  SELECT t.qid, count(a.id) AS hits, count(*) AS tl
  FROM truth t LEFT JOIN ann a ON a.qid = t.qid AND a.id = t.id GROUP BY t.qid) h ON h.qid = q.qid"""


def q_recall_sweep(spark, sf):
    p = evaluate(base(spark, sf), _cfg()).points
    return p.select("sweep_idx", F.col("effort").alias("nprobe"), _r6(F.col("recall")).alias("recall"),
                    _r6(F.col("scanned_per_query")).alias("scanned_per_query"))


SQL_RECALL_SWEEP = _EVAL_SQL_HEAD + """,
pts AS (SELECT sweep_idx, effort, avg(recall) AS recall FROM per GROUP BY sweep_idx, effort),
cs AS (SELECT sweep_idx, avg(scanned) AS spq FROM cost GROUP BY sweep_idx)
SELECT pts.sweep_idx, pts.effort AS nprobe, round(pts.recall, 6) AS recall, round(cs.spq, 6) AS scanned_per_query
FROM pts LEFT JOIN cs ON cs.sweep_idx = pts.sweep_idx"""


def q_default_point(spark, sf):
    p = evaluate(base(spark, sf), _cfg()).points
    d = recall.default_point(p, DEFAULT_EFFORT)
    return d.select("sweep_idx", F.col("effort").alias("nprobe"), _r6(F.col("recall")).alias("recall"))


SQL_DEFAULT_POINT = _EVAL_SQL_HEAD + f""",
pts AS (SELECT sweep_idx, effort, avg(recall) AS recall FROM per GROUP BY sweep_idx, effort)
SELECT sweep_idx, effort AS nprobe, round(recall, 6) AS recall FROM pts
ORDER BY (effort = {DEFAULT_EFFORT}) DESC,
         CASE WHEN effort = {DEFAULT_EFFORT} THEN sweep_idx ELSE -sweep_idx END DESC LIMIT 1"""


KMEANS_STEPS = 4


def q_ivf_kmeans_sweep(spark, sf):
    """K6 with k-means, on the scaled vectors: their lists are of unequal size."""
    cfg = EvalConfig(metric="l2", k=K, queries=N_QUERIES, lists=LISTS, efforts=EFFORTS,
                     trainer="kmeans", kmeans_steps=KMEANS_STEPS, seed=SEED)
    p = evaluate(base(spark, sf, True), cfg).points
    return p.select("sweep_idx", F.col("effort").alias("nprobe"), _r6(F.col("recall")).alias("recall"),
                    _r6(F.col("scanned_per_query")).alias("scanned_per_query"))


def _sql_ivf_kmeans_sweep():
    steps = [S.ivf_ctes("l2", LISTS).split("asg AS (")[0].replace("cent AS", "c0 AS").rstrip().rstrip(","),
             """bits AS (SELECT least(40, 62 - ceil(log2(count(*) * max(list_max(list_transform(v, lambda x: abs(x::DOUBLE))))))) AS bits
  FROM src WHERE v IS NOT NULL)"""]
    for i in range(KMEANS_STEPS):
        split = "coalesce(t.far, m.c)" if i < KMEANS_STEPS - 1 else "m.c"
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT id, v, list_id, d FROM (
    SELECT b.id, b.v, c.list_id, {S.dist('l2', 'b.v', 'c.c')} AS d,
           row_number() OVER (PARTITION BY b.id ORDER BY {S.dist('l2', 'b.v', 'c.c')}, c.list_id) AS rn
    FROM src b CROSS JOIN c{i} c WHERE b.v IS NOT NULL) s WHERE rn = 1),
e{i} AS (SELECT list_id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}),
s{i} AS (SELECT list_id, j, sum(floor(x::DOUBLE * power(2.0, bits) + 0.5)::HUGEINT) AS total, count(*) AS n FROM e{i}, bits GROUP BY list_id, j),
g{i} AS (SELECT list_id, list((total::DOUBLE / (n * power(2.0, bits)))::FLOAT ORDER BY j) AS c, any_value(n) AS n FROM s{i}, bits GROUP BY list_id),
far{i} AS (SELECT list_id, v AS far FROM (SELECT list_id, v, row_number() OVER (PARTITION BY list_id ORDER BY d DESC, id) AS r FROM a{i}) WHERE r = 1),
m{i} AS (SELECT c.list_id, coalesce(g.n, 0) AS n, coalesce(g.c, c.c) AS c, far.far, avg(coalesce(g.n, 0)) OVER () AS mean
  FROM c{i} c LEFT JOIN g{i} g USING (list_id) LEFT JOIN far{i} far USING (list_id)),
t{i} AS (SELECT sm.list_id, lg.far FROM
  (SELECT list_id, row_number() OVER (ORDER BY n, list_id) AS j FROM m{i} WHERE n < mean / {SPLIT}) sm JOIN
  (SELECT far, row_number() OVER (ORDER BY n DESC, list_id) AS j FROM m{i} WHERE n > {SPLIT} * mean) lg USING (j)),
c{i + 1} AS MATERIALIZED (SELECT m.list_id, {split} AS c FROM m{i} m LEFT JOIN t{i} t USING (list_id))""")
    rest = S.ivf_ctes("l2", LISTS)
    return f"""WITH src AS ({S.src_embeddings(True)}), {S.queries_cte(N_QUERIES)},
{S.knn_cte('truth', 'l2', K)},
{", ".join(steps)},
cent AS (SELECT list_id, c FROM c{KMEANS_STEPS}),
asg AS ({rest.split("asg AS (", 1)[1]},
{S.efforts_cte(EFFORTS)},
{S.sweep_ctes('truth')}""" + SQL_RECALL_SWEEP.split(S.sweep_ctes("truth"))[1]


# --- S4 ------------------------------------------------------------------------

def q_synthetic_profile(spark, sf):
    """S4 over the table's ids and dimension: one synthetic unit vector per row."""
    e = base(spark, sf)
    dim = e.select(F.max(F.size("embedding"))).first()[0]
    syn = vectors_for_ids(e.select("id"), int(dim), SEED)
    return (syn.select(F.size("embedding").alias("s"), D.norm("embedding").alias("n"))
            .agg(F.count("*").alias("rows"), F.max("s").cast("int").alias("dim"),
                 F.round(F.min("n"), 5).alias("min_norm"), F.round(F.max("n"), 5).alias("max_norm")))


SQL_SYNTHETIC_PROFILE = """SELECT count(*) AS rows, max(len(embedding))::INTEGER AS dim,
       1.0::DOUBLE AS min_norm, 1.0::DOUBLE AS max_norm FROM embeddings"""


# --- P4, S7 (rows-only: file sizes and nested documents have no SQL twin) ------

def q_stored_size(spark, sf):
    return profile.stored_size(table(spark, sf, "embeddings"))


def _result_document(spark, sf):
    from nnprobe import __version__
    from nnprobe.operators import measure as M
    from nnprobe.sources.sinks import result_document

    env = profile.profile(base(spark, sf), "id", "embedding")
    m = M.from_events(table(spark, sf, "events"))
    lat = M.latency_summary(M.with_warmup(m, "phase").where(~F.col("warmup")), group=())
    lv = M.levels(m)
    at = F.pmod("seq", F.lit(len(EFFORTS)))
    timed = m.select(at.cast("int").alias("sweep_idx"), F.element_at(F.array(*map(F.lit, EFFORTS)), (at + 1).cast("int")).alias("effort"),
                     "started_us", "ended_us", "dur_ms")
    pts = recall.timed_points(evaluate(base(spark, sf), _cfg()).points, recall.sweep_timings(timed))
    cfg = {"metric": "cosine", "k": K, "queries": N_QUERIES, "lists": LISTS, "efforts": list(EFFORTS)}
    span = m.agg(F.min("started_us"), F.max("ended_us")).first()
    stamp = lambda us: F.timestamp_micros(F.lit(us))
    return result_document(env, cfg, lat, lv, pts, recall.default_point(pts, DEFAULT_EFFORT), M.saturation(lv),
                           started_at=stamp(span[0]), finished_at=stamp(span[1]), tool_version=__version__)


def q_result_document(spark, sf):
    """S7, flattened: one row per recall point beside the document's other figures."""
    d = _result_document(spark, sf)
    p = F.explode("recall.points").alias("p")
    return d.select("env.rows", F.col("config.k").alias("k"), F.col("latency.count").alias("count"), _r6(F.col("latency.p95_ms")).alias("p95_ms"),
                    F.size("throughput.levels").cast("int").alias("levels"), _r6(F.col("throughput.peak_qps")).alias("peak_qps"),
                    "throughput.peak_level", "throughput.saturated_at", F.col("recall.default.effort").alias("default_effort"),
                    F.unix_micros("run.started_at").alias("started_us"), F.unix_micros("run.finished_at").alias("finished_us"), p).select(
        "*", F.col("p.effort").alias("effort"), _r6(F.col("p.recall")).alias("recall"), _r6(F.col("p.p95_ms")).alias("point_p95_ms"),
        _r6(F.col("p.qps")).alias("point_qps")).drop("p")


def _sql_result_document():
    from nnprobe.plans.catalog_measure import _SQL_LEVELS, _SQL_PEAK
    from nnprobe.operators import measure as M
    return _EVAL_SQL_HEAD + f""",
pts AS (SELECT sweep_idx, effort, avg(recall) AS recall FROM per GROUP BY sweep_idx, effort),
{_SQL_LEVELS}, {_SQL_PEAK},
g AS (SELECT run_id, level_idx, qps, lag(qps) OVER (PARTITION BY run_id ORDER BY level_idx) AS pq,
             lag(concurrency) OVER (PARTITION BY run_id ORDER BY level_idx) AS pc FROM lv),
st AS (SELECT arg_min(pc, level_idx) AS sat FROM g WHERE pq > 0 AND (qps - pq) / pq < {M.SATURATION_GAIN}),
w AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY seq) AS rn FROM m),
la AS (SELECT count(*) AS count, quantile_cont(dur_ms, 0.95) AS p95 FROM w WHERE rn > {M.WARMUP}),
ti AS (SELECT seq % {len(EFFORTS)} AS sweep_idx, quantile_cont(dur_ms, 0.95) AS p95,
         count(*) / ((max(ended_us) - min(started_us)) / 1e6) AS qps FROM m GROUP BY 1)
SELECT (SELECT count(*) FROM src) AS rows, {K}::INTEGER AS k, la.count, round(la.p95, 6) AS p95_ms, (SELECT count(*) FROM lv)::INTEGER AS levels,
  round(pk2.peak_qps, 6) AS peak_qps, pk2.peak_level::INTEGER AS peak_level, coalesce(st.sat, pk2.peak_level)::INTEGER AS saturated_at,
  {DEFAULT_EFFORT}::INTEGER AS default_effort, (SELECT min(started_us) FROM m) AS started_us, (SELECT max(ended_us) FROM m) AS finished_us,
  pts.effort, round(pts.recall, 6) AS recall, round(ti.p95, 6) AS point_p95_ms, round(ti.qps, 6) AS point_qps
FROM pts JOIN ti ON ti.sweep_idx = pts.sweep_idx CROSS JOIN la CROSS JOIN pk2 LEFT JOIN st ON true"""


def entries():
    out = {}
    for name, metric in (("vec_l2", "l2"), ("vec_neg_ip", "ip"), ("vec_cosine", "cosine")):
        out[name] = _vec_metric(metric)
    out["vec_normalize"] = (q_vec_normalize, SQL_VEC_NORMALIZE)
    out["vec_parse"] = (q_vec_parse, SQL_VEC_PARSE)
    out["profile"] = (q_profile, SQL_PROFILE)
    out["facts"] = (q_facts, SQL_FACTS)
    out["sample_queries"] = (q_sample_queries, SQL_SAMPLE_QUERIES)
    out["sample_block"] = (q_sample_block, SQL_SAMPLE_BLOCK)
    out["workload_expand"] = (q_workload_expand, SQL_WORKLOAD_EXPAND)
    out["knn_l2"] = _knn("l2", True)
    out["knn_ip"] = _knn("ip", True)
    out["knn_cosine"] = _knn("cosine", True)
    out["knn_cosine_expr"] = _knn("cosine", True, strategy="expr")
    out["knn_with_self"] = _knn("cosine", False, exclude_self=False)
    out["scan_audit"] = (q_scan_audit, SQL_SCAN_AUDIT)
    out["ivf_assign"] = (q_ivf_assign, SQL_IVF_ASSIGN)
    out["ivf_search"] = (q_ivf_search, SQL_IVF_SEARCH)
    out["ivf_search_all"] = (q_ivf_search_all, SQL_IVF_SEARCH_ALL)
    out["ivf_cost"] = (q_ivf_cost, SQL_IVF_COST)
    out["recall_per_query"] = (q_recall_per_query, SQL_RECALL_PER_QUERY)
    out["recall_sweep"] = (q_recall_sweep, SQL_RECALL_SWEEP)
    out["default_point"] = (q_default_point, SQL_DEFAULT_POINT)
    out["ivf_kmeans_sweep"] = (q_ivf_kmeans_sweep, _sql_ivf_kmeans_sweep())
    out["synthetic_profile"] = (q_synthetic_profile, SQL_SYNTHETIC_PROFILE)
    out["stored_size"] = (q_stored_size, None)
    out["result_document"] = (q_result_document, _sql_result_document())
    return out
