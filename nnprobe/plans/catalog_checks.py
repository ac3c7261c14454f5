"""Registered queries for operators that need extreme, stored or derived
inputs (S2, S5, S6, S8, P5, W4, K1-K4, K6, R5, R6, J3-J6, T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nnprobe.functions.distance import searchable
from nnprobe.functions.vectext import parse, render
from nnprobe.operators import ivf, knn, measure, nearest, profile, recall, sampling
from nnprobe.operators.runlog import timed_evaluation
from nnprobe.plans import sqlparts as S
from nnprobe.plans.catalog_vectors import DEFAULT_EFFORT, EFFORTS, K, LISTS, N_QUERIES, NPROBE, SEED, SQL_IVF_SEARCH, base
from nnprobe.plans.evaluation import EvalConfig, evaluate
from nnprobe.session import scratch_path, stored, table
from nnprobe.sources.sinks import measurement_runs, read_measurements, write_measurements
from nnprobe.sources.synthetic import drop_dataset, drop_table, read_dataset, write_dataset, write_table


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- S2 ------------------------------------------------------------------------

# Text forms of row n, by n modulo 8; {} is the rendered vector.
TEXT_FORMS = ("{}", " {} ", "{}1f]", "[1e40]", "{}x", "[]", "[1,,2]", "[ -.5 , 2e-3,nan ]")


def q_vec_parse_malformed(spark, sf):
    text = render("embedding")
    forms = F.lit(None).cast("string")
    for k, form in enumerate(TEXT_FORMS):
        left, _, right = form.partition("{}") if "{}" in form else ("", "", form)
        forms = F.when(F.col("id") % 8 == k, F.concat(F.lit(left), text, F.lit(right)) if "{}" in form else F.lit(form)).otherwise(forms)
    b = base(spark, sf).select("id", forms.alias("t"))
    vec, err = parse("t")
    return b.select("id", F.size(vec).cast("int").alias("dim"), err.alias("vec_error"))


SQL_VEC_PARSE_MALFORMED = """SELECT vec_id AS id,
  CASE WHEN vec_id % 8 IN (0, 1) THEN len(embedding) WHEN vec_id % 8 = 5 THEN 0 WHEN vec_id % 8 = 7 THEN 3 END::INTEGER AS dim,
  vec_id % 8 IN (2, 3, 4, 6) AS vec_error FROM embeddings"""


# --- K1-K4 on values at the ends of FLOAT, and with rows that are not searchable ----

SCALES = (1e20, 1.0, 1e-25)


def _extreme(spark, sf):
    f = F.element_at(F.array(*[F.lit(x) for x in SCALES]), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                                 F.transform("embedding", lambda x: (x * f).cast("float")).alias("embedding"))


def q_knn_extreme(spark, sf):
    b = _extreme(spark, sf)
    out = None
    for metric in ("l2", "ip", "cosine"):
        q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
        got = knn.exact_knn(b, q, K, metric).select(F.lit(metric).alias("metric"), "qid", "rank", "id")
        out = got if out is None else out.unionByName(got)
    return out


def _sql_knn_extreme():
    src = ("src AS (SELECT vec_id AS id, list_transform(embedding, lambda x: "
           "(x * (CASE vec_id % 3 WHEN 0 THEN 1e20 WHEN 1 THEN 1.0 ELSE 1e-25 END)::DOUBLE)::FLOAT) AS v FROM embeddings)")
    parts, ctes = [], [src, S.queries_cte(N_QUERIES)]
    for metric in ("l2", "ip", "cosine"):
        ctes.append(S.knn_cte(f"k_{metric}", metric, K))
        parts.append(f"SELECT '{metric}' AS metric, qid, rank, id FROM k_{metric}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


def _odd(spark, sf):
    """Every 7th vector NULL, every 7th + 1 with a NaN, every 7th + 2 infinite, every 7th + 3 shorter."""
    n, v = F.col("vec_id") % 7, F.col("embedding")
    bad = lambda x: F.concat(F.array(F.lit(float(x)).cast("float")), F.slice(v, F.lit(2), F.size(v) - 1))
    e = (F.when(n == 0, F.lit(None)).when(n == 1, bad("nan")).when(n == 2, bad("inf"))
         .when(n == 3, F.slice(v, F.lit(1), F.size(v) - 1)).otherwise(v))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), e.alias("embedding"))


def _knn_null_rows(strategy):
    def run(spark, sf):
        b = _odd(spark, sf)
        dim = b.agg(F.max(F.size("embedding"))).first()[0]        # a query set has one dimension
        q = sampling.sample_queries(b.where(searchable("embedding") & (F.size("embedding") == F.lit(dim))), N_QUERIES, seed=SEED)
        return knn.exact_knn(b, q, K, "cosine", strategy=strategy).select("qid", "rank", "id", _r6("distance").alias("distance"))
    return run


SQL_KNN_NULL_ROWS = f"""WITH odd AS (SELECT vec_id AS id, CASE vec_id % 7 WHEN 0 THEN NULL
    WHEN 1 THEN list_concat(['nan'::FLOAT], embedding[2:]) WHEN 2 THEN list_concat(['inf'::FLOAT], embedding[2:])
    WHEN 3 THEN embedding[1:len(embedding) - 1] ELSE embedding END AS v FROM embeddings),
src AS (SELECT * FROM odd WHERE v IS NOT NULL AND NOT list_bool_or(list_transform(v, lambda x: isnan(x) OR isinf(x)))
        AND len(v) = (SELECT max(len(v)) FROM odd)), {S.queries_cte(N_QUERIES)},
{S.knn_cte('knn', 'cosine', K)}
SELECT qid, rank, id, round(distance, 6) AS distance FROM knn"""


# --- P5, K7: a stored index is found and opened again --------------------------

def _manifest(spark, sf):
    b = base(spark, sf)
    index = ivf.build_index(b, ivf.train_sample(b, LISTS, "cosine", SEED), "cosine")
    return b, stored(index.manifest(spark, "embeddings", "embedding"), "manifest")[0]


def q_index_lookup(spark, sf):
    _, m = _manifest(spark, sf)
    hit = profile.index_lookup(m, "embeddings", "embedding")
    miss = profile.index_lookup(m, "embeddings", "other")
    return hit.unionByName(miss).select("table", "column", "index_name", "kind", "metric", "lists",
                                        F.coalesce(F.col("size_bytes") > 0, F.lit(False)).alias("stored"))


SQL_INDEX_LOOKUP = f"""SELECT 'embeddings' AS "table", 'embedding' AS "column", 'embeddings_embedding_ivf' AS index_name,
  'ivfflat' AS kind, 'cosine' AS metric, {LISTS}::INTEGER AS lists, count(*) > 0 AS stored FROM embeddings
UNION ALL SELECT 'embeddings', 'other', NULL, 'none', NULL, NULL, false"""


def q_index_facts(spark, sf):
    """P7 with sizes; the figures of the files are left out, as no SQL sees them."""
    _, m = _manifest(spark, sf)
    sizes = profile.stored_size(table(spark, sf, "embeddings"))
    found = profile.index_facts(profile.index_lookup(m, "embeddings", "embedding"), sizes)
    none = profile.index_facts(profile.index_lookup(m, "embeddings", "other"), sizes)
    return found.unionByName(none).select("key", F.regexp_replace("value", r"[0-9.]+ (B|[KMGTPE]iB)$", "SIZE").alias("value"))


SQL_INDEX_FACTS = f"""SELECT 'table size' AS key, 'SIZE' AS value UNION ALL SELECT 'table size', 'SIZE'
UNION ALL SELECT 'index', 'ivfflat lists={LISTS} · SIZE' UNION ALL SELECT 'index', 'none'"""


def q_ivf_reopened(spark, sf):
    b, m = _manifest(spark, sf)
    index = ivf.open_index(spark, profile.index_lookup(m, "embeddings", "embedding").first())
    q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
    return ivf.search(spark, index, q, K, NPROBE).select("qid", "rank", "id", _r6("distance").alias("distance"))


# --- K6: k-means, by what must hold whatever the centroids are -----------------

def q_ivf_kmeans_invariants(spark, sf):
    cfg = EvalConfig(metric="l2", k=K, queries=N_QUERIES, lists=LISTS, efforts=EFFORTS, trainer="kmeans", seed=SEED)
    p = evaluate(base(spark, sf), cfg).points
    rows = F.array_sort(F.collect_list(F.struct("sweep_idx", "recall", "scanned_per_query")))
    a = p.agg(rows.alias("r"))
    rising = lambda c: F.sort_array(F.col(f"r.{c}")) == F.col(f"r.{c}")
    return a.select(F.size("r").cast("int").alias("points"), rising("recall").alias("recall_rises"),
                    rising("scanned_per_query").alias("cost_rises"), _r6(F.element_at("r", -1)["recall"]).alias("full_recall"),
                    _r6(F.element_at("r", -1)["scanned_per_query"]).alias("full_cost"))


SQL_IVF_KMEANS_INVARIANTS = f"""SELECT {len(EFFORTS)}::INTEGER AS points, true AS recall_rises, true AS cost_rises,
  1.0::DOUBLE AS full_recall, count(*)::DOUBLE AS full_cost FROM embeddings WHERE embedding IS NOT NULL"""


# --- W4, R5, R6 ------------------------------------------------------------------

def q_draw_rule(spark, sf):
    """For a run of 30 queries with a recall sample of 50, and the other way round."""
    b, out = base(spark, sf), None
    for queries, recall_sample in ((30, 50), (50, 30)):
        drawn, for_recall = sampling.draw_queries(b, queries, recall_sample, seed=SEED)
        part = drawn.select(F.lit(queries).alias("queries"), F.lit(recall_sample).alias("recall_sample"), "pos", "qid").join(
            for_recall.select("qid", F.lit(True).alias("in_recall")), "qid", "left")
        part = part.withColumn("in_recall", F.coalesce("in_recall", F.lit(False))).select(
            "queries", "recall_sample", "pos", "qid", "in_recall")
        out = part if out is None else out.unionByName(part)
    return out


SQL_DRAW_RULE = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(50)}
SELECT w.queries::INTEGER AS queries, w.recall_sample::INTEGER AS recall_sample, q.pos, q.qid, q.pos < w.recall_sample AS in_recall
FROM q CROSS JOIN (VALUES (30, 50), (50, 30)) w(queries, recall_sample)"""


def q_recall_gate(spark, sf):
    kinds = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select(
        "label", F.element_at(F.array(*map(F.lit, ("hnsw", "ivfflat", "none", "btree"))), (F.col("label") % 4 + 1).cast("int")).alias("kind"))
    q = sampling.sample_queries(base(spark, sf), N_QUERIES, seed=SEED)
    g = recall.gate(kinds.select("kind").distinct(), q)
    return kinds.join(g, "kind").select("label", "kind", F.col("n_queries").cast("long").alias("n_queries"), "run", "warning")


SQL_RECALL_GATE = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)},
k AS (SELECT DISTINCT label, (['hnsw', 'ivfflat', 'none', 'btree'])[(label % 4 + 1)::INTEGER] AS kind FROM embeddings)
SELECT label, kind, (SELECT count(*) FROM q) AS n_queries, kind IN ('hnsw', 'ivfflat') AS run,
  CASE WHEN kind IN ('hnsw', 'ivfflat') THEN NULL ELSE '{recall.GATE_WARNING}' END AS warning FROM k"""


def q_sweep_timings(spark, sf):
    m = measure.from_events(table(spark, sf, "events"))
    at = F.pmod("seq", F.lit(len(EFFORTS)))
    m = m.select(at.cast("int").alias("sweep_idx"), F.element_at(F.array(*map(F.lit, EFFORTS)), (at + 1).cast("int")).alias("effort"),
                 "started_us", "ended_us", "dur_ms")
    return recall.sweep_timings(m).select("sweep_idx", "effort", _r6("p95_ms").alias("p95_ms"), "queries",
                                          _r6("wall_s").alias("wall_s"), _r6("qps").alias("qps"))


SQL_SWEEP_TIMINGS = f"""WITH {S.measurements_cte()},
s AS (SELECT (seq % {len(EFFORTS)})::INTEGER AS sweep_idx, ({list(EFFORTS)})[(seq % {len(EFFORTS)} + 1)::INTEGER]::INTEGER AS effort, * FROM m)
SELECT sweep_idx, effort, round(quantile_cont(dur_ms, 0.95), 6) AS p95_ms, count(*) AS queries,
  round((max(ended_us) - min(started_us)) / 1e6, 6) AS wall_s,
  round(count(*) / ((max(ended_us) - min(started_us)) / 1e6), 6) AS qps FROM s GROUP BY 1, 2"""


def q_search_timings(spark, sf):
    """R6, M12, S8 from real searches: the run's rows are written, read back and
    summed up per effort; times differ from run to run, so of them only that
    they are there is told."""
    b = base(spark, sf)
    q = sampling.sample_queries(b, N_QUERIES, seed=SEED)
    log, found, truth = timed_evaluation(spark, b, q, K, LISTS, EFFORTS, "search-timings", exclude_self=False)
    path = scratch_path(spark, "search-timings")
    write_measurements(log.rows(spark), path)
    back = read_measurements(spark, path)
    stages = measure.stage_durations(back).where("phase IN ('build', 'truth', 'search') AND duration_ns > 0").count()
    notes = log.rows(spark).where("phase = 'search'")
    t = recall.sweep_timings(back.where("phase = 'search'").join(notes.select("seq", "sweep_idx", "effort"), "seq"))
    sums = notes.groupBy("sweep_idx").agg(F.sum("queries").alias("queries"), F.sum("compared").alias("compared"), F.sum("found").alias("found"))
    right = (found.join(truth.select("qid", "id"), ["qid", "id"]).groupBy("sweep_idx").agg(F.count("*").alias("right")))
    return (t.select("sweep_idx", "effort", ((F.col("p95_ms") > 0) & (F.col("wall_s") > 0) & (F.col("qps") > 0)).alias("timed"))
            .join(sums, "sweep_idx").join(right, "sweep_idx").withColumn("stages", F.lit(stages)))


SQL_SEARCH_TIMINGS = f"""WITH src AS ({S.src_embeddings()}), {S.queries_cte(N_QUERIES)},
{S.knn_cte('truth', 'cosine', K, False)},
{S.ivf_ctes('cosine', LISTS)},
{S.efforts_cte(EFFORTS)},
{S.sweep_ctes('truth')}
SELECT c.sweep_idx, c.effort, true AS timed, count(*) AS queries, sum(c.scanned)::BIGINT AS compared, sum(least({K}, c.scanned))::BIGINT AS found,
  sum(p.hits)::BIGINT AS "right", 3::INTEGER AS stages
FROM cost c JOIN per p ON p.qid = c.qid AND p.sweep_idx = c.sweep_idx GROUP BY c.sweep_idx, c.effort"""


# --- P5: many columns at once ----------------------------------------------------

def q_index_lookup_many(spark, sf):
    """Every column that rows of the table ask for, in a manifest of an index per row."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("table"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("i") % n + 1).cast("int"))
    column = lambda n: F.concat(F.lit("c"), (F.col("i") % n).cast("string"))
    manifest = e.select(
        F.concat(F.lit("ix"), F.col("i").cast("string")).alias("index_name"), pick(("hnsw", "ivfflat", "btree"), 3).alias("kind"), "table",
        F.array(column(5), column(7)).alias("columns"), pick(("l2", "cosine"), 2).alias("metric"), (F.col("i") % 100).cast("int").alias("lists"),
        F.col("i").alias("size_bytes"), F.timestamp_seconds(F.floor(F.col("i") / 10)).alias("created_at"))
    asked = e.select("table", column(11).alias("column"))
    return profile.index_lookups(manifest, asked).select("table", "column", "index_name", "kind", "metric", "lists", "size_bytes")


SQL_INDEX_LOOKUP_MANY = """WITH e AS (SELECT vec_id AS i, 't' || label::VARCHAR AS tbl FROM embeddings),
m AS (SELECT i, tbl, 'ix' || i::VARCHAR AS index_name, (['hnsw', 'ivfflat', 'btree'])[(i % 3 + 1)::INTEGER] AS kind,
        unnest(list_distinct(['c' || (i % 5)::VARCHAR, 'c' || (i % 7)::VARCHAR])) AS col, (['l2', 'cosine'])[(i % 2 + 1)::INTEGER] AS metric,
        (i % 100)::INTEGER AS lists FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY i // 10 DESC, index_name) AS r FROM m WHERE kind IN ('hnsw', 'ivfflat')),
a AS (SELECT DISTINCT tbl, 'c' || (i % 11)::VARCHAR AS col FROM e)
SELECT a.tbl AS "table", a.col AS "column", r.index_name, coalesce(r.kind, 'none') AS kind, r.metric, r.lists, r.i AS size_bytes
FROM a LEFT JOIN r ON r.tbl = a.tbl AND r.col = a.col AND r.r = 1"""


# --- J5 ----------------------------------------------------------------------------

def q_comparison_rows(spark, sf):
    """The run's figures beside those of the label whose count of rows comes nearest to its share."""
    m = measure.from_events(table(spark, sf, "events"))
    lat, lv = measure.latency_summary(m, group=()), measure.levels(m)
    pk = measure.peak(lv)
    points = evaluate(base(spark, sf), EvalConfig(metric="cosine", k=K, queries=N_QUERIES, lists=LISTS, efforts=EFFORTS, seed=SEED)).points
    point = recall.default_point(points, DEFAULT_EFFORT)
    measured = lat.crossJoin(pk.select("peak_qps")).crossJoin(point.select("recall", "effort"))              # one row each
    g = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    near = g.agg(F.min_by(F.struct("label", "n"), F.struct(F.abs(F.col("n") - 50), "label")).alias("g"))
    projected = near.select((F.col("g.label") + 1.25).alias("p50_ms"), (F.col("g.label") + 2.5).alias("p95_ms"),
                            (F.col("g.n") * 10.0).alias("qps"), (1.0 / (F.col("g.label") + 1)).alias("recall"))
    rows = lambda p, name: nearest.comparison_rows(measured, p).withColumn("reference", F.lit(name))
    got = rows(projected, "found").unionByName(rows(None, "none"))
    return got.select("reference", "metric", _r6("measured").alias("measured"), _r6("projected").alias("projected"))


def _sql_comparison_rows():
    from nnprobe.plans.catalog_measure import _SQL_LEVELS, _SQL_PEAK
    from nnprobe.plans.catalog_vectors import _EVAL_SQL_HEAD
    return _EVAL_SQL_HEAD + f""",
pts AS (SELECT sweep_idx, effort, avg(recall) AS recall FROM per GROUP BY sweep_idx, effort),
{_SQL_LEVELS}, {_SQL_PEAK},
la AS (SELECT quantile_cont(dur_ms, 0.5) AS p50, quantile_cont(dur_ms, 0.95) AS p95 FROM m),
g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY abs(count(*) - 50), label LIMIT 1),
rows4 AS (SELECT unnest(['p50_ms', 'p95_ms', 'peak_qps', 'recall']) AS metric,
  unnest([la.p50, la.p95, pk2.peak_qps, (SELECT recall FROM pts WHERE effort = {DEFAULT_EFFORT})]) AS measured,
  unnest([g.label + 1.25, g.label + 2.5, g.n * 10.0, 1.0 / (g.label + 1)]::DOUBLE[]) AS projected FROM la, pk2, g)
SELECT 'found' AS reference, metric, round(measured, 6) AS measured, round(projected, 6) AS projected FROM rows4
UNION ALL SELECT 'none', metric, round(measured, 6), NULL FROM rows4"""


# --- S5, S8 ------------------------------------------------------------------------

def q_write_replace_drop(spark, sf):
    """The vectors written twice as a table and as a dataset, read back, and dropped."""
    name = "nnprobe_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    path, versions = scratch_path(spark, "dataset"), scratch_path(spark, "versions")
    for write in (lambda df: write_table(df, name, versions), lambda df: write_dataset(df, path)):
        write(base(spark, sf).limit(0))
        write(base(spark, sf))
    dim = F.size("embedding").cast("int")
    got = spark.read.table(name).select("id", dim.alias("dim")).join(
        read_dataset(spark, path).select("id", dim.alias("dataset_dim")), "id")
    got, _ = stored(got, "written")
    drop_table(spark, name, versions)
    drop_dataset(spark, path)
    return got.withColumn("dropped", F.lit(not spark.catalog.tableExists(name)))


SQL_WRITE_REPLACE_DROP = """SELECT vec_id AS id, len(embedding)::INTEGER AS dim, len(embedding)::INTEGER AS dataset_dim,
  true AS dropped FROM embeddings"""


def q_measurement_sink(spark, sf):
    """The events written as measurement rows in two runs, the first of them
    twice, read back and summarised beside the manifest's row counts."""
    path = scratch_path(spark, "measurements")
    ev = table(spark, sf, "events")
    for run in (0, 1, 0):
        write_measurements(measure.from_events(ev.where(F.col("event_id") % 2 == run), f"run{run}"), path)
    s = measure.latency_summary(read_measurements(spark, path))
    runs = measurement_runs(spark, path).select("run_id", F.col("rows").alias("run_rows"))
    return s.join(runs, "run_id").select("run_id", "run_rows", "phase", "count",
                                         *[_r6(c).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")])


SQL_MEASUREMENT_SINK = f"""WITH {S.measurements_cte()},
n AS (SELECT seq % 2 AS run, count(*) AS run_rows FROM m GROUP BY 1)
SELECT 'run' || (seq % 2)::VARCHAR AS run_id, any_value(run_rows) AS run_rows, phase, count(*) AS count, round(avg(dur_ms), 6) AS mean_ms,
  round(quantile_cont(dur_ms, 0.5), 6) AS p50_ms, round(quantile_cont(dur_ms, 0.95), 6) AS p95_ms,
  round(quantile_cont(dur_ms, 0.99), 6) AS p99_ms FROM m JOIN n ON n.run = seq % 2 GROUP BY 1, 3"""


# --- S6, J3-J6 ---------------------------------------------------------------------

def q_projection(spark, sf):
    """Measured shapes (one per label) beside the nearest bucket of a reference document read back from storage."""
    from nnprobe.sources.reference import read_reference
    e = table(spark, sf, "embeddings")
    g = e.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("int").alias("dim"))
    bucket = F.struct("dim", F.col("n").alias("rows"), F.lit("ivfflat").alias("index"), F.lit(0).alias("m"), F.lit(0).alias("ef_construction"),
                      (F.col("label") * 10 + 10).cast("int").alias("ef_search"), (F.col("label") * 100 + 0.5).alias("qps"),
                      (F.col("label") + 1.25).alias("p50_ms"), (F.col("label") + 2.5).alias("p95_ms"),
                      (F.lit(1.0) / (F.col("label") + 1)).alias("recall"))
    path = scratch_path(spark, "reference")
    (g.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", bucket.alias("b")))), lambda x: x["b"]).alias("buckets"))
     .select(F.lit("2024-01-01").alias("generated_at"), F.lit("none").alias("method_url"), "buckets").write.json(path))
    buckets = stored(read_reference(spark, path), "buckets")[0]
    effort = nearest.effort_for_projection((F.col("label") * 8).cast("int"), F.lit(DEFAULT_EFFORT))
    work = g.select(F.col("label").alias("workload_id"), "dim", F.col("n").alias("rows"), F.lit("ivfflat").alias("index"), effort.alias("ef_search"))
    hit = nearest.nearest_reference(work, buckets)
    b = buckets.select("bucket_pos", "qps", "p50_ms", "p95_ms", F.col("recall").alias("b_recall"))
    got = work.join(hit, "workload_id").join(b, "bucket_pos", "left")
    return got.select("workload_id", F.col("ef_search").alias("effort"), "found", "bucket_pos",
                      *nearest.shape_row("dim", "rows", "cosine", F.coalesce("p95_ms", F.lit(0.0)), F.coalesce("qps", F.lit(0.0)),
                                         F.coalesce("b_recall", F.lit(0.0)), F.lit("ivfflat")))


def _sql_projection():
    def rd(a, b):
        return f"(CASE WHEN greatest(abs({a}), abs({b})) = 0 THEN 0.0 ELSE abs(({a}) - ({b})) / greatest(abs({a}), abs({b})) END)"

    bucket = ("CASE WHEN w.rows < 1000 THEN '<1k' WHEN w.rows < 10000 THEN '1k' WHEN w.rows < 100000 THEN '10k' WHEN w.rows < 1000000 THEN '100k' "
              "WHEN w.rows < 10000000 THEN '1M' WHEN w.rows < 100000000 THEN '10M' ELSE '>100M' END")
    return f"""WITH g AS (SELECT label, count(*) AS n, max(len(embedding))::INTEGER AS dim FROM embeddings GROUP BY label),
b AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INTEGER AS bucket_pos, label, dim, n AS rows, (label * 10 + 10)::DOUBLE AS ef FROM g),
w AS (SELECT label AS workload_id, dim, n AS rows, CASE WHEN label = 0 THEN {DEFAULT_EFFORT} ELSE label * 8 END::INTEGER AS ef FROM g),
c AS (SELECT w.workload_id, b.bucket_pos, ({rd('b.dim', 'w.dim')} + {rd('b.rows', 'w.rows')} +
        CASE WHEN w.ef > 0 AND b.ef > 0 THEN {rd('b.ef', 'w.ef')} ELSE 0.0 END) / 3.0 AS d FROM w CROSS JOIN b),
best AS (SELECT workload_id, arg_min(bucket_pos, (d, bucket_pos)) AS bucket_pos FROM c GROUP BY workload_id HAVING min(d) <= {nearest.MAX_NORM})
SELECT w.workload_id, w.ef AS effort, best.bucket_pos IS NOT NULL AS found, best.bucket_pos, w.dim AS dims, {bucket} AS rows_bucket,
  'cosine' AS metric, printf('%.1f', coalesce(b.label + 2.5, 0.0)::DOUBLE) AS p95, printf('%.0f', round_even(coalesce(b.label * 100 + 0.5, 0.0)::DOUBLE, 0)) AS qps,
  printf('%.3f', coalesce(1.0 / (b.label + 1), 0.0)::DOUBLE) AS recall, 'ivfflat' AS "index"
FROM w LEFT JOIN best USING (workload_id) LEFT JOIN b ON b.bucket_pos = best.bucket_pos"""


def entries():
    return {
        "vec_parse_malformed": (q_vec_parse_malformed, SQL_VEC_PARSE_MALFORMED),
        "knn_extreme": (q_knn_extreme, _sql_knn_extreme()),
        "knn_null_rows": (_knn_null_rows("block"), SQL_KNN_NULL_ROWS),
        "knn_null_rows_expr": (_knn_null_rows("expr"), SQL_KNN_NULL_ROWS),
        "index_lookup": (q_index_lookup, SQL_INDEX_LOOKUP),
        "index_facts": (q_index_facts, SQL_INDEX_FACTS),
        "ivf_reopened": (q_ivf_reopened, SQL_IVF_SEARCH),
        "ivf_kmeans_invariants": (q_ivf_kmeans_invariants, SQL_IVF_KMEANS_INVARIANTS),
        "draw_rule": (q_draw_rule, SQL_DRAW_RULE),
        "recall_gate": (q_recall_gate, SQL_RECALL_GATE),
        "search_timings": (q_search_timings, SQL_SEARCH_TIMINGS),
        "index_lookup_many": (q_index_lookup_many, SQL_INDEX_LOOKUP_MANY),
        "comparison_rows": (q_comparison_rows, _sql_comparison_rows()),
        "sweep_timings": (q_sweep_timings, SQL_SWEEP_TIMINGS),
        "write_replace_drop": (q_write_replace_drop, SQL_WRITE_REPLACE_DROP),
        "measurement_sink": (q_measurement_sink, SQL_MEASUREMENT_SINK),
        "projection": (q_projection, _sql_projection()),
    }
