"""Positions and percentiles within a key, without sending a key to one task.

``row_number() OVER (PARTITION BY key ORDER BY seq)`` sorts every key inside
a single task; with a handful of keys (levels, phases) one key can hold a
third of the table.  Here the rows are range-partitioned on (key, order) and
stored in the shared folder together with their partition number.  Windows
then run per (partition, key), and a small table of per-partition counts
gives each slice its offset.  Both read the stored split, so they agree
whatever the planner reuses or retries; NULL keys are a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.session import stored




def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that pairs NULL keys too; the keys of ``left`` stay."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"_r_{k}"])
    got = left.join(r, cond, how)
    return got if how in ("left_semi", "left_anti") else got.drop(*[f"_r_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, out: str = "before",
            partitions: int | None = None, rows_out: str | None = None) -> DataFrame:
    """Adds ``out``: the rows (or the sum of ``weight``) of the key that come
    before this row by ``order``, which must be unique within a key; with
    ``rows_out`` also the number of those rows."""
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, _ = stored(df.repartitionByRange(p, *keys, *order).withColumn("_pid", F.spark_partition_id()), "ranges")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    totals = {out: F.col(weight) if weight else one} | ({rows_out: one} if rows_out else {})
    by_part = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (part.groupBy("_pid", *keys).agg(*[F.sum(w).alias(f"_n_{c}") for c, w in totals.items()])
               .select("_pid", *keys, *[F.coalesce(F.sum(f"_n_{c}").over(by_part), zero).alias(f"_off_{c}") for c in totals]))
    here = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumns({f"_local_{c}": F.coalesce(F.sum(w).over(here), zero) for c, w in totals.items()})
    return (join_keys(local, offsets, ["_pid", *keys])
            .withColumns({c: (F.col(f"_off_{c}") + F.col(f"_local_{c}")).cast("long") for c in totals})
            .drop("_pid", *[f"_{k}_{c}" for k in ("local", "off") for c in totals]))


def positions(df: DataFrame, key: str, order: str | list[str], out: str = "position",
              partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = 1-based position of the row within ``key`` by ``order``
    (``order`` must be unique within a key)."""
    order = [order] if isinstance(order, str) else order
    return running(df, [key], order, out=out, partitions=partitions).withColumn(out, F.col(out) + 1)


ACCURACY = 10_000             # of the sketch that brackets a rank: its error is rows / ACCURACY
BRACKET_ROWS = 400_000        # distinct values of a bracket that one task may rank
KEY_BROADCAST_ROWS = 100_000  # keys whose brackets are shipped whole, some 200 bytes each


def _between(ps, names, n: str, value) -> list[Column]:
    """Linear between the values ``value(i, side)`` at the ranks around p * (n - 1)."""
    out = []
    for i, (p, name) in enumerate(zip(ps, names, strict=True)):
        rank = F.lit(float(p)) * (F.col(n) - 1)
        part = rank - F.floor(rank)
        out.append((value(i, "f") * (1 - part) + value(i, "g") * part).alias(name))
    return out


def _ranked(counts: DataFrame, keys: list[str], col: str, ps, names) -> DataFrame:
    """Percentiles from (keys, value, _c, _lo), ``_lo`` rows of the key being
    smaller, and ``_n`` rows in all; a rank that no row covers gives NULL."""
    picked = []
    for i, p in enumerate(ps):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        for side, at in (("f", F.floor(rank)), ("g", F.ceil(rank))):
            inside = (F.col("_lo") <= at) & (at < F.col("_lo") + F.col("_c"))
            picked.append(F.max(F.when(inside, F.col(col))).alias(f"_{side}{i}"))
    got = counts.groupBy(*keys).agg(F.max("_n").alias("_n"), *picked)
    return got.select(*keys, *_between(ps, names, "_n", lambda i, side: F.col(f"_{side}{i}")))


def percentiles_by_ranges(df: DataFrame, keys: list[str], col: str, ps, names, weight: str | None = None) -> DataFrame:
    """Exact percentiles from all distinct values, ranked by ranges: equal
    values are counted (or their ``weight`` summed) before the shuffle."""
    c = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    r = running(c, keys, [col], "_c", "_lo")
    n = r.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    return _ranked(join_keys(r, n, keys), keys, col, ps, names)


def percentiles_by_brackets(df: DataFrame, keys: list[str], col: str, ps, names, extra: dict[str, Column] | None = None,
                            accuracy: int = ACCURACY) -> DataFrame | None:
    """Exact percentiles in two passes over ``df`` that shuffle no rows.

    A mergeable sketch per key gives two values between which each wanted rank
    lies; the second pass counts what is below them and the equal values
    between them, which one task per key ranks.  ``extra`` aggregates come
    from the first pass.  None where a bracket would hold too many values, or
    where one missed its rank."""
    rows = df.where(F.col(col).isNotNull())
    around = [min(max(p + d, 0.0), 1.0) for p in ps for d in (-2.0 / accuracy, 2.0 / accuracy)]
    seen = df.groupBy(*keys).agg(
        F.count(col).alias("_n"), F.percentile_approx(col, [float(a) for a in around], accuracy).alias("_at"),
        *[c.alias(name) for name, c in (extra or {}).items()]).checkpoint(eager=True)       # one row a key
    size = seen.agg(F.count("*").alias("keys"), F.max("_n").alias("n")).first()
    if size["keys"] > KEY_BROADCAST_ROWS or (size["n"] or 0) * 5 * len(ps) > accuracy * BRACKET_ROWS:
        return None
    bounds = F.broadcast(seen.where("_n > 0").select(*keys, "_n", "_at"))
    x = join_keys(rows.select(*keys, col), bounds, keys)
    low, high = (lambda i: F.col("_at")[2 * i]), (lambda i: F.col("_at")[2 * i + 1])
    # rows of a key between two brackets count for the next one: one group per stretch of values
    inside = F.lit(False)
    for i in range(len(ps)):
        inside = inside | ((F.col(col) >= low(i)) & (F.col(col) <= high(i)))
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    stretch = F.lit(0)
    for i in order:
        stretch = stretch + (F.col(col) > high(i)).cast("int")
    counts = (x.select(*keys, "_n", F.when(inside, F.col(col)).alias(col), F.when(~inside, stretch).alias("_s"))
              .groupBy(*keys, col, "_s").agg(F.count("*").alias("_c"), F.max("_n").alias("_n")))
    # a stretch comes before the values above it: its place is the bracket it precedes
    place = F.coalesce(F.col("_s"), sum((F.col(col) > F.col("_at")[2 * i + 1]).cast("int") for i in order))
    counts = join_keys(counts, bounds.select(*keys, "_at"), keys).select(
        *keys, col, "_c", "_n", place.alias("_place"))
    w = Window.partitionBy(*keys).orderBy("_place", F.col(col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_lo", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    got = _ranked(counts, keys, col, ps, names).checkpoint(eager=True)                      # one row a key
    if not got.where(" OR ".join(f"`{n}` IS NULL" for n in names)).isEmpty():
        return None
    return join_keys(seen.select(*keys, *extra), got, keys, "left") if extra else got


def grouped_percentiles(df: DataFrame, keys: list[str], col: str, ps, names, weight: str | None = None,
                        extra: dict[str, Column] | None = None) -> DataFrame:
    """Exact percentiles (linear between ranks, p * (n - 1)) per key: one row
    per key with the columns ``names``; NULL values do not count.  ``extra``
    holds aggregates of all rows of the key by name."""
    if weight is None:
        got = percentiles_by_brackets(df, keys, col, ps, names, extra)
        if got is not None:
            return got
    got = percentiles_by_ranges(df, keys, col, ps, names, weight)
    if extra:
        got = join_keys(df.groupBy(*keys).agg(*[c.alias(name) for name, c in extra.items()]), got, keys, "left")
    return got


def explode_range(df: DataFrame, lo: Column, hi: Column, out: str, step: Column | int = 1, chunk: int = 10_000) -> DataFrame:
    """``df`` once per value from ``lo`` to ``hi`` (as ``out``); long ranges
    are unfolded in two steps, so no row ever holds more than ``chunk`` values."""
    step = F.lit(step).cast("long") if isinstance(step, int) else step.cast("long")
    lo, hi = lo.cast("long"), hi.cast("long")
    a = df.where(lo <= hi).select("*", hi.alias("_hi"), step.alias("_step"), F.explode(F.sequence(lo, hi, step * chunk)).alias("_lo"))
    last = F.least(F.col("_hi"), F.col("_lo") + F.col("_step") * (chunk - 1))
    return a.withColumn(out, F.explode(F.sequence("_lo", last, "_step"))).drop("_hi", "_lo", "_step")
