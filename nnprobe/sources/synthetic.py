"""Synthetic unit vectors (S4) and dataset writes.

Each coordinate is a Box-Muller normal from two hash-derived uniforms of
(seed, id, coordinate), the vector is divided by its norm in double and
stored as FLOAT (left unnormalised if the norm is below 1e-12).  Because the
randomness is a function of (seed, id), the same rows come out for any
partitioning and on any retry; generation runs on the executors.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nnprobe.functions.distance import divide_by
from nnprobe.session import folders, read_text, remove_path, replace_text

TWO_53 = 2 ** 53


def _uniform(seed: int, id_col: Column, i: Column, stream: int) -> Column:
    h = F.xxhash64(F.lit(seed), id_col, i, F.lit(stream))
    return F.pmod(h, F.lit(TWO_53)).cast("double") / float(TWO_53)


def _two_step(ids: DataFrame, id_col: str, dim: int, seed: int) -> DataFrame:
    """Coordinates first (one column), then the division: the normals are
    generated once per element and the norm once per row."""
    i = F.col(id_col)
    z = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: F.sqrt(F.lit(-2.0) * F.log(_uniform(seed, i, j, 1) + F.lit(1e-12)))
        * F.cos(F.lit(2 * math.pi) * _uniform(seed, i, j, 2)))
    g = ids.select(i.alias("id")).select("id", z.alias("_z"))
    n = F.sqrt(F.aggregate("_z", F.lit(0.0), lambda acc, x: acc + x * x))
    g = g.select("id", "_z", n.alias("_n"))
    return g.select("id", F.when(F.col("_n") < F.lit(1e-12), F.transform("_z", lambda x: x.cast("float")))
                    .otherwise(divide_by(F.col("_z"), F.col("_n"))).alias("embedding"))


def unit_vectors(spark, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """Ids 1..rows with random unit vectors (the synthetic dataset)."""
    if not (1 <= rows and 1 <= dim):
        raise ValueError("rows and dim must be positive")
    return _two_step(spark.range(1, rows + 1), "id", dim, seed)


def vectors_for_ids(ids: DataFrame, dim: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """S4 over an existing id column (e.g. a table's keys)."""
    return _two_step(ids, id_col, dim, seed)


POINTER = "_current"          # names the version that readers see; hidden from Spark's listings


def _write_version(df: DataFrame, path: str) -> str:
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    return version


def _drop_versions(spark, path: str, keep: tuple[str, ...]) -> None:
    for name in folders(spark, path):
        if name.startswith("v-") and name not in keep:
            remove_path(spark, f"{path}/{name}")


def write_dataset(df: DataFrame, path: str, partitions: int | None = None) -> str:
    """Replace the vector table at ``path``; Spark's partitioning is the
    batching.  Every write is a new version folder, and the pointer file is
    renamed over last: a write that fails leaves the table as it was, readers
    see one version or the other, and those that still read the version before
    may finish, as only older ones are removed."""
    spark = df.sparkSession
    before = read_text(spark, f"{path}/{POINTER}")
    version = _write_version(df.repartition(partitions) if partitions else df, path)
    replace_text(spark, f"{path}/{POINTER}", version)
    _drop_versions(spark, path, (version, before))
    return path


def read_dataset(spark, path: str) -> DataFrame:
    """The current version of a table of ``write_dataset``."""
    version = read_text(spark, f"{path}/{POINTER}")
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def drop_dataset(spark, path: str) -> None:
    remove_path(spark, path)


def write_table(df: DataFrame, name: str, path: str | None = None) -> str:
    """S5 for catalog tables: the rows are written first, as a version under
    ``path`` (the warehouse's folder of the name by default), and the table is
    then pointed at them; a write that fails leaves the table as it was."""
    spark = df.sparkSession
    path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}.versions"
    version = _write_version(df, path)
    schema = df.schema.simpleString()
    if spark.catalog.tableExists(name) and spark.read.table(name).schema.simpleString() == schema:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}/{version}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, f"{path}/{version}", source="parquet")
    spark.catalog.refreshTable(name)
    _drop_versions(spark, path, (version,))
    return name


def drop_table(spark, name: str, path: str | None = None) -> None:
    """Remove the synthetic table and its versions after the run."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}.versions"
    _drop_versions(spark, path, ())
    remove_path(spark, path)
