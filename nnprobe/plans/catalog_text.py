"""Registered queries over all tables, ``documents``, ``conversations`` and
``pages`` (J1-J3, J6-J10, P6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.functions import privacy
from nnprobe.functions.text import format_bytes, format_int, parse_index_def, rows_bucket
from nnprobe.operators import nearest
from nnprobe.plans import sqlparts as S
from nnprobe.session import spread, table

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- J7 ------------------------------------------------------------------------

def q_rows_bucket(spark, sf):
    parts = [table(spark, sf, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
             for t in TABLES]
    u = reduce(DataFrame.unionByName, parts)
    return u.select("table_name", "rows", rows_bucket("rows").alias("rows_bucket"))


def _sql_bucket(n):
    return (f"CASE WHEN {n} < 1000 THEN '<1k' WHEN {n} < 10000 THEN '1k' WHEN {n} < 100000 THEN '10k' "
            f"WHEN {n} < 1000000 THEN '100k' WHEN {n} < 10000000 THEN '1M' WHEN {n} < 100000000 THEN '10M' "
            f"ELSE '>100M' END")


SQL_ROWS_BUCKET = "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES) + \
    f")\nSELECT table_name, rows, {_sql_bucket('rows')} AS rows_bucket FROM c"


# --- J8 ------------------------------------------------------------------------

def q_format_sizes(spark, sf):
    d = table(spark, sf, "documents")
    g = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return g.select("source", "docs", "chars", format_int("docs").alias("docs_text"),
                    format_bytes("chars").alias("chars_text"))


def _sql_format_bytes(n):
    units = "KMGTPE"
    parts = [f"CASE WHEN {n} < 1024 THEN {n}::VARCHAR || ' B'"]
    for i, u in enumerate(units):
        div = 1024 ** (i + 1)
        txt = f"printf('%.1f {u}iB', round_even(({n})::DOUBLE / {div}, 1))"
        parts.append(f"WHEN {n} < {div * 1024} THEN {txt}" if i < len(units) - 1 else f"ELSE {txt} END")
    return " ".join(parts)


SQL_FORMAT_SIZES = f"""WITH g AS (SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source)
SELECT source, docs, chars,
       CASE WHEN docs < 1000 THEN docs::VARCHAR ELSE format('{{:,}}', docs) END AS docs_text,
       {_sql_format_bytes('chars')} AS chars_text FROM g"""


# --- P6 ------------------------------------------------------------------------

def _ddl_spark(label, count):
    l_ = label.cast("string")
    c_ = count.cast("string")
    hnsw = F.concat(F.lit("hnsw (embedding vector_cosine_ops) WITH (m='"), (label + 8).cast("string"),
                    F.lit("', ef_construction='"), c_, F.lit("')"))
    ivf = F.concat(F.lit("ivfflat (embedding vector_l2_ops) WITH (lists = "), c_, F.lit(")"))
    half = F.lit("hnsw (embedding halfvec_l2_ops)")
    body = F.when(label % 3 == 0, half).when(label % 2 == 0, hnsw).otherwise(ivf)
    return F.concat(F.lit("CREATE INDEX emb_"), l_, F.lit(" ON public.embeddings USING "), body)


def q_parse_index_def(spark, sf):
    g = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    d = g.select("label", _ddl_spark(F.col("label"), F.col("n")).alias("ddl"))
    p = parse_index_def("ddl")
    return d.select("label", "ddl", p["m"].alias("m"), p["ef_construction"].alias("ef_construction"),
                    p["lists"].alias("lists"), p["opclass"].alias("opclass"))


SQL_PARSE_INDEX_DEF = r"""WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
d AS (SELECT label, 'CREATE INDEX emb_' || label::VARCHAR || ' ON public.embeddings USING ' ||
        CASE WHEN label % 3 = 0 THEN 'hnsw (embedding halfvec_l2_ops)'
             WHEN label % 2 = 0 THEN 'hnsw (embedding vector_cosine_ops) WITH (m=''' || (label + 8)::VARCHAR ||
                                     ''', ef_construction=''' || n::VARCHAR || ''')'
             ELSE 'ivfflat (embedding vector_l2_ops) WITH (lists = ' || n::VARCHAR || ')' END AS ddl FROM g)
SELECT label, ddl,
  coalesce(TRY_CAST(nullif(regexp_extract(ddl, '(?i)\bm\s*=\s*''?(\d+)''?', 1), '') AS INTEGER), 0) AS m,
  coalesce(TRY_CAST(nullif(regexp_extract(ddl, '(?i)ef_construction\s*=\s*''?(\d+)''?', 1), '') AS INTEGER), 0) AS ef_construction,
  coalesce(TRY_CAST(nullif(regexp_extract(ddl, '(?i)\blists\s*=\s*''?(\d+)''?', 1), '') AS INTEGER), 0) AS lists,
  regexp_extract(ddl, '(?i)\b(vector_(?:cosine|l2|ip)_ops|halfvec_\w+_ops|bit_\w+_ops|sparsevec_\w+_ops)\b', 1) AS opclass
FROM d"""


# --- J9, J10 ---------------------------------------------------------------------

def _sql_escape(s: str) -> str:
    return s.replace("'", "''")


def _sql_scrub(col: str) -> str:
    out = col
    for _, pat, rep in S.SCRUB_RULES_RE2:
        out = f"regexp_replace({out}, '{_sql_escape(pat)}', '{_sql_escape(rep)}', 'g')"
    return out


def q_scrub_documents(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", privacy.scrub("text").alias("text"))


SQL_SCRUB_DOCUMENTS = f"SELECT doc_id, {_sql_scrub('text')} AS text FROM documents"


def q_scrub_conversations(spark, sf):
    c = spread(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return c.select("conv_id", "turn", "role", privacy.scrub("text").alias("text"))


SQL_SCRUB_CONVERSATIONS = f"SELECT conv_id, turn, role, {_sql_scrub('text')} AS text FROM conversations"


def q_scrub_counts(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    st = privacy.scrub_stages("text")
    return d.select("doc_id", *[cnt.cast("int").alias(f"{name}_hits") for name, cnt, _ in st])


def _sql_scrub_counts():
    cols, cur = [], "text"
    for name, pat, rep in S.SCRUB_RULES_RE2:
        p = _sql_escape(pat)
        cols.append(f"len(regexp_extract_all({cur}, '{p}'))::INTEGER AS {name}_hits")
        cur = f"regexp_replace({cur}, '{p}', '{_sql_escape(rep)}', 'g')"
    return f"SELECT doc_id, {', '.join(cols)} FROM documents"


SQL_SCRUB_COUNTS = _sql_scrub_counts()


# Forms of user information put before the host of page n, by n modulo 8.
URL_FORMS = ("https://admin:s3cret@{}", "postgres://u:p@ss@{}", "postgres://a@b:pw@{}", "//u:pw@{}", "https://u:pw@h:80x/{}",
             "https://u ser:pw@{}", "https://reader@{}", "{}")


def q_redact_urls(spark, sf):
    rest = F.regexp_replace("url", "^https?://", "")
    url = F.lit(None).cast("string")
    for k, form in enumerate(URL_FORMS):
        left, right = form.split("{}")
        url = F.when(F.col("page_id") % 8 == k, F.concat(F.lit(left), rest if left else F.col("url"), F.lit(right))).otherwise(url)
    p = table(spark, sf, "pages").select("page_id", url.alias("url"))
    return p.select("page_id", "url", privacy.redact_url("url").alias("redacted"))


def _sql_redact():
    forms = " ".join(f"WHEN page_id % 8 = {k} THEN " + (f"'{f.split('{}')[0]}' || regexp_replace(url, '^https?://', '')" if f != "{}" else "url")
                     for k, f in enumerate(URL_FORMS))
    # what each form must become, told from the form itself
    return f"""WITH p AS (SELECT page_id, CASE {forms} END AS url, regexp_replace(url, '^https?://', '') AS rest, url AS plain FROM pages)
SELECT page_id, url, CASE WHEN regexp_matches(plain, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN '<redacted>'
  ELSE CASE page_id % 8 WHEN 0 THEN 'https://admin:***@' || rest WHEN 1 THEN 'postgres://u:***@' || rest
  WHEN 2 THEN 'postgres://a%40b:***@' || rest WHEN 3 THEN '//u:***@' || rest WHEN 4 THEN '<redacted>' WHEN 5 THEN '<redacted>'
  ELSE url END END AS redacted FROM p"""


SQL_REDACT_URLS = _sql_redact()


# --- J1-J3 -----------------------------------------------------------------------

def _label_shapes(spark, sf):
    e = table(spark, sf, "embeddings")
    g = e.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    # one row per label from here on
    w = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cum", F.sum("n").over(w))


def q_nearest_reference(spark, sf):
    """Workloads: one per label with the cumulative row count; references:
    one measured bucket per label (even labels ivfflat, odd hnsw)."""
    s = _label_shapes(spark, sf)
    buckets = s.select(F.col("label").alias("bucket_pos"), F.col("dim").cast("int").alias("dim"),
                       F.col("n").alias("rows"),
                       F.when(F.col("label") % 2 == 0, "ivfflat").otherwise("hnsw").alias("index"),
                       (F.col("label") * 10 + 10).cast("int").alias("ef_search"))
    work = s.select(F.col("label").alias("workload_id"), F.col("dim").cast("int").alias("dim"),
                    F.col("cum").alias("rows"), F.lit("ivfflat").alias("index"),
                    (F.col("label") * 8).cast("int").alias("ef_search"))
    r = nearest.nearest_reference(work, buckets)
    return r.select("workload_id", "found", "bucket_pos", _r6("distance_norm").alias("distance_norm"))


def _rd(a, b):
    return f"(CASE WHEN greatest(abs({a}), abs({b})) = 0 THEN 0.0 ELSE abs(({a}) - ({b})) / greatest(abs({a}), abs({b})) END)"


SQL_NEAREST_REFERENCE = f"""WITH g AS (SELECT label, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY label),
s AS (SELECT *, sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
b AS (SELECT label AS bucket_pos, dim::DOUBLE AS dim, n::DOUBLE AS rows,
             CASE WHEN label % 2 = 0 THEN 'ivfflat' ELSE 'hnsw' END AS idx, (label * 10 + 10)::DOUBLE AS ef FROM s),
w AS (SELECT label AS workload_id, dim::DOUBLE AS dim, cum::DOUBLE AS rows, 'ivfflat' AS idx, (label * 8)::DOUBLE AS ef FROM s),
c AS (SELECT w.workload_id, b.bucket_pos,
             ({_rd('b.dim', 'w.dim')} + {_rd('b.rows', 'w.rows')} +
              CASE WHEN w.ef > 0 AND b.ef > 0 THEN {_rd('b.ef', 'w.ef')} ELSE 0.0 END) / 3.0 AS d
      FROM w JOIN b ON (w.idx = '' OR b.idx = w.idx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY d, bucket_pos) AS r FROM c) t
         WHERE r = 1 AND d <= {nearest.MAX_NORM})
SELECT w.workload_id, best.bucket_pos IS NOT NULL AS found, best.bucket_pos, round(best.d, 6) AS distance_norm
FROM w LEFT JOIN best ON best.workload_id = w.workload_id"""


def entries():
    return {
        "rows_bucket": (q_rows_bucket, SQL_ROWS_BUCKET),
        "format_sizes": (q_format_sizes, SQL_FORMAT_SIZES),
        "parse_index_def": (q_parse_index_def, SQL_PARSE_INDEX_DEF),
        "scrub_documents": (q_scrub_documents, SQL_SCRUB_DOCUMENTS),
        "scrub_conversations": (q_scrub_conversations, SQL_SCRUB_CONVERSATIONS),
        "scrub_counts": (q_scrub_counts, SQL_SCRUB_COUNTS),
        "redact_urls": (q_redact_urls, SQL_REDACT_URLS),
        "nearest_reference": (q_nearest_reference, SQL_NEAREST_REFERENCE),
    }
