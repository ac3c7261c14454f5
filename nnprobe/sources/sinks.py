"""Sinks: measurement rows (S8) and the nested result document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.operators.ranking import join_keys

# Fixed measurement-row schema: what ``from_events`` makes and M1-M12 read.
MEASUREMENT_SCHEMA = ("phase string, level string, worker long, seq long, ended_us long, started_us long, "
                      "dur_ms double, run_id string")


# Fixed privacy note carried by every result document.
PRIVACY_NOTE = "Counts, timings and recall figures only: no vectors, names, hosts or credentials."


RUNS = "_runs"                # the manifest's folder; hidden from the table's own listings
RUNS_SCHEMA = "rows long, started_us long, ended_us long, written_at timestamp, run_id string"


def write_measurements(df: DataFrame, path: str) -> str:
    """Measurement rows, one folder per run.  A run's folder is replaced
    whole (dynamic partition overwrite) and other runs' stay, so a run that is
    written again, after a failure or by a retry, is there once.  The manifest
    gets its line (rows, first start, last end) once the rows are in place; a
    run without one was not finished."""
    names = [f.strip().split(" ")[0] for f in MEASUREMENT_SCHEMA.split(",")]
    spark, rows = df.sparkSession, df.select(*names)
    once = {"partitionOverwriteMode": "dynamic"}
    rows.write.mode("overwrite").options(**once).partitionBy("run_id").parquet(path)
    runs = rows.select("run_id").distinct()                   # one row a run
    lines = measurement_lines(join_keys(read_measurements(spark, path), runs, ["run_id"], "left_semi"))
    lines.write.mode("overwrite").options(**once).partitionBy("run_id").parquet(f"{path}/{RUNS}")
    return path


def measurement_lines(m: DataFrame) -> DataFrame:
    """The manifest's line of every run among the rows."""
    return m.groupBy("run_id").agg(F.count("*").alias("rows"), F.min("started_us").alias("started_us"),
                                   F.max("ended_us").alias("ended_us"), F.current_timestamp().alias("written_at"))


def read_measurements(spark, path: str) -> DataFrame:
    """The rows written by ``write_measurements``, as the statistics read them."""
    return spark.read.schema(MEASUREMENT_SCHEMA).parquet(path)


def measurement_runs(spark, path: str) -> DataFrame:
    """The finished runs at ``path``: run_id, rows, started_us, ended_us, written_at."""
    return spark.read.schema(RUNS_SCHEMA).parquet(f"{path}/{RUNS}").select(
        "run_id", "rows", "started_us", "ended_us", "written_at")


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def result_document(env: DataFrame, config: dict, latency: DataFrame, levels: DataFrame,
                    points: DataFrame, default_point: DataFrame, peak: DataFrame | None = None,
                    projection: DataFrame | None = None, reference: DataFrame | None = None,
                    started_at=None, finished_at=None, tool_version: str | None = None) -> DataFrame:
    """One row of nested structs: env, config, latency, throughput (levels,
    peak_qps, peak_level, saturated_at), recall (points with p95 and queries
    per second where they were timed, default point), projection, reference
    (the header of the reference document), run (started, finished, version)
    and privacy.  Parts without input are NULL.  Every input is already an
    aggregate (one row, or one row per level / effort), so the arrays are
    bounded by those counts."""
    spark = env.sparkSession
    cfg = spark.createDataFrame([tuple(config.values())], ", ".join(
        f"{k} {'array<int>' if isinstance(v, (list, tuple)) else ('int' if isinstance(v, int) and not isinstance(v, bool) else 'string')}"
        for k, v in config.items()))
    lv = levels.agg(F.array_sort(F.collect_list(F.struct(
        "level_idx", "concurrency", "qps", "p95_ms", "duration_ns", "total_queries"))).alias("levels"))
    for c in ("p95_ms", "qps"):
        if c not in points.columns:
            points = points.withColumn(c, F.lit(None).cast("double"))
    pts = points.agg(F.array_sort(F.collect_list(F.struct("sweep_idx", "effort", "recall", "p95_ms", "qps"))).alias("points"))
    dp = default_point.select(F.struct("sweep_idx", "effort", "recall").alias("default"))
    pk = (peak.select("peak_qps", "peak_level", "saturated_at") if peak is not None else
          spark.range(1).selectExpr("CAST(NULL AS DOUBLE) AS peak_qps", "CAST(NULL AS INT) AS peak_level", "CAST(NULL AS INT) AS saturated_at"))
    doc = _one(env, "env")
    for part in (_one(cfg, "config"), _one(latency, "latency"), lv, pts, dp, pk,
                 _one(projection, "projection") if projection is not None else None,
                 _one(reference, "reference") if reference is not None else None):
        if part is not None:
            doc = doc.crossJoin(part)                      # one row each
    null = F.lit(None).cast("string")
    return doc.select(
        "env", "config", "latency", F.struct("levels", "peak_qps", "peak_level", "saturated_at").alias("throughput"),
        F.struct("points", "default").alias("recall"),
        F.col("projection") if projection is not None else null.alias("projection"),
        F.col("reference") if reference is not None else null.alias("reference"),
        F.struct(F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(finished_at).cast("timestamp").alias("finished_at"),
                 F.lit(tool_version).cast("string").alias("tool_version")).alias("run"),
        F.struct(F.lit(PRIVACY_NOTE).alias("note")).alias("privacy"))


def write_document(doc: DataFrame, path: str) -> str:
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path
