"""DuckDB SQL fragments for the oracle side of the registered queries.

The oracle is an independent formulation of the same semantics in plain
SQL (cross joins and window ranks), run by DuckDB on the same parquet files.
"""

from __future__ import annotations

SEED = 42


def src_embeddings(scaled: bool = False) -> str:
    """(id, v FLOAT[]): the table, or the metric-discriminating scaled view."""
    if scaled:
        return ("SELECT vec_id AS id, list_transform(embedding, lambda x: "
                "(x * (1 + (vec_id % 7) / 2.0)::DOUBLE)::FLOAT) AS v FROM embeddings")
    return "SELECT vec_id AS id, embedding AS v FROM embeddings"


def md5_key(id_expr: str, salt: str | None = None, seed: int = SEED) -> str:
    parts = [f"'{seed}'"] + ([f"'{salt}'"] if salt else []) + [f"{id_expr}::VARCHAR"]
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def dist(metric: str, a: str, b: str) -> str:
    a, b = f"({a})::DOUBLE[]", f"({b})::DOUBLE[]"
    if metric == "l2":
        return f"list_distance({a}, {b})"
    if metric == "ip":
        return f"(0.0::DOUBLE - list_inner_product({a}, {b}))"
    na, nb = f"list_inner_product({a}, {a})", f"list_inner_product({b}, {b})"
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 1.0::DOUBLE "
            f"ELSE 1.0 - list_inner_product({a}, {b}) / (sqrt({na}) * sqrt({nb})) END)")


def sqnorm(v: str) -> str:
    return f"list_sum(list_transform(({v})::DOUBLE[], lambda y: y * y))"


def normalized(v: str) -> str:
    n = f"sqrt({sqnorm(v)})"
    return (f"(CASE WHEN {n} < 1e-12 THEN {v} "
            f"ELSE list_transform({v}, lambda x: (x::DOUBLE / {n})::FLOAT) END)")


def prepared(metric: str, v: str) -> str:
    return normalized(v) if metric in ("cosine", "ip") else v


def queries_cte(n: int, src: str = "src") -> str:
    """q(pos, qid, qv): the n smallest md5 keys among non-NULL vectors."""
    return f"""q AS (
  SELECT (row_number() OVER (ORDER BY k, id) - 1)::INTEGER AS pos, id AS qid, v AS qv
  FROM (SELECT id, v, {md5_key('id')} AS k FROM {src} WHERE v IS NOT NULL ORDER BY k, id LIMIT {n}) s)"""


def knn_cte(name: str, metric: str, k: int, exclude_self: bool = True,
            src: str = "src", q: str = "q", extra_where: str = "") -> str:
    """name(qid, rank, id, distance): exact top-k over the whole table."""
    self_cond = "AND b.id <> q.qid" if exclude_self else ""
    return f"""{name} AS (
  SELECT qid, rank, id, distance FROM (
    SELECT q.qid, b.id, {dist(metric, 'q.qv', 'b.v')} AS distance,
           (row_number() OVER (PARTITION BY q.qid ORDER BY {dist(metric, 'q.qv', 'b.v')}, b.id))::INTEGER AS rank
    FROM {q} q CROSS JOIN {src} b
    WHERE b.v IS NOT NULL AND len(b.v) = len(q.qv) {self_cond} {extra_where}) s
  WHERE rank <= {k})"""


def ivf_ctes(metric: str, lists: int, src: str = "src", q: str = "q") -> str:
    """cent(list_id, c), asg(id, list_id, list_distance), pr(qid, list_id, probe_rank)."""
    return f"""cent AS (
  SELECT (row_number() OVER (ORDER BY k, id) - 1)::INTEGER AS list_id, c
  FROM (SELECT id, {prepared(metric, 'v')} AS c, {md5_key('id', 'train')} AS k
        FROM {src} WHERE v IS NOT NULL ORDER BY k, id LIMIT {lists}) s),
asg AS (
  SELECT id, list_id, list_distance FROM (
    SELECT b.id, c.list_id, {dist('l2', 'b.p', 'c.c')} AS list_distance,
           row_number() OVER (PARTITION BY b.id ORDER BY {dist('l2', 'b.p', 'c.c')}, c.list_id) AS rn
    FROM (SELECT id, {prepared(metric, 'v')} AS p FROM {src} WHERE v IS NOT NULL) b CROSS JOIN cent c) s
  WHERE rn = 1),
pr AS (
  SELECT q.qid, c.list_id,
         (row_number() OVER (PARTITION BY q.qid ORDER BY {dist('l2', prepared(metric, 'q.qv'), 'c.c')}, c.list_id))::INTEGER AS probe_rank
  FROM {q} q CROSS JOIN cent c)"""


def efforts_cte(efforts) -> str:
    vals = ", ".join(f"({i}, {int(e)})" for i, e in enumerate(efforts))
    return f"eff AS (SELECT sweep_idx::INTEGER AS sweep_idx, effort::INTEGER AS effort FROM (VALUES {vals}) t(sweep_idx, effort))"


def sweep_ctes(truth: str = "truth") -> str:
    """per(qid, sweep_idx, effort, hits, truth_len, recall) over the query grid,
    cost(qid, sweep_idx, effort, scanned)."""
    return f"""tr AS (
  SELECT t.qid, pr.probe_rank FROM {truth} t
  LEFT JOIN asg ON asg.id = t.id
  LEFT JOIN pr ON pr.qid = t.qid AND pr.list_id = asg.list_id),
hits AS (
  SELECT tr.qid, e.sweep_idx, e.effort, count(*) FILTER (WHERE tr.probe_rank <= e.effort) AS hits,
         count(*) AS truth_len
  FROM tr CROSS JOIN eff e GROUP BY tr.qid, e.sweep_idx, e.effort),
per AS (
  SELECT g.qid, e.sweep_idx, e.effort, coalesce(h.hits, 0)::BIGINT AS hits,
         coalesce(h.truth_len, 0)::BIGINT AS truth_len,
         CASE WHEN coalesce(h.truth_len, 0) > 0 THEN h.hits / h.truth_len ELSE 0.0 END AS recall
  FROM q g CROSS JOIN eff e
  LEFT JOIN hits h ON h.qid = g.qid AND h.sweep_idx = e.sweep_idx),
sizes AS (SELECT list_id, count(*) AS list_size FROM asg GROUP BY list_id),
nl AS (SELECT qid, max(probe_rank) AS n_lists FROM pr GROUP BY qid),
cost AS (
  SELECT pr.qid, e.sweep_idx, e.effort, sum(coalesce(s.list_size, 0))::BIGINT AS scanned
  FROM pr JOIN nl ON nl.qid = pr.qid CROSS JOIN eff e
  LEFT JOIN sizes s ON s.list_id = pr.list_id
  WHERE pr.probe_rank <= least(e.effort, nl.n_lists)
  GROUP BY pr.qid, e.sweep_idx, e.effort)"""


def measurements_cte() -> str:
    """m: the events table read as measurement rows."""
    return """m AS (
  SELECT 'events' AS run_id, event_type AS level, event_type AS phase, user_id AS worker,
         event_id AS seq, epoch_us(ts) AS ended_us, value AS dur_ms,
         CAST(round(value * 1000) AS BIGINT) AS dur_us,
         epoch_us(ts) - CAST(round(value * 1000) AS BIGINT) AS started_us
  FROM events)"""


# The same rules in RE2 syntax (for SQL engines with RE2, e.g. the oracle).
SCRUB_RULES_RE2 = [
    ("url", "postgres(?:ql)?://[^\\s'\"]+", "postgres://<redacted>"),
    ("ip", "\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}(?::\\d+)?\\b", "<ip>"),
    ("host", "[a-zA-Z0-9][a-zA-Z0-9._-]*\\.(?:[a-zA-Z]{2,}|[a-zA-Z]+\\.[a-zA-Z]{2,})(?::\\d+)?", "<host>"),
    ("conn", "(?i)`user=[^`]*`", "`<conn>`"),
]
