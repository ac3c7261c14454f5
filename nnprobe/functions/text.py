"""Text and number scalars (J7, J8, P6) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed row-count buckets: (upper bound exclusive, label).
ROWS_BUCKETS = [(1_000, "<1k"), (10_000, "1k"), (100_000, "10k"), (1_000_000, "100k"),
                (10_000_000, "1M"), (100_000_000, "10M")]
ROWS_BUCKET_TOP = ">100M"

# Fixed binary byte units after "B".
BYTE_UNITS = "KMGTPE"


def rows_bucket(n) -> Column:
    """Exact row count -> bucket label (lower bound inclusive)."""
    n = _c(n)
    expr = F.when(n < ROWS_BUCKETS[0][0], F.lit(ROWS_BUCKETS[0][1]))
    for bound, label in ROWS_BUCKETS[1:]:
        expr = expr.when(n < bound, F.lit(label))
    return expr.otherwise(F.lit(ROWS_BUCKET_TOP))


def format_int(n) -> Column:
    """Thousands separators; negatives printed plainly."""
    n = _c(n).cast("long")
    return F.when(n < 1000, n.cast("string")).otherwise(F.format_number(n, 0))


def format_bytes(n) -> Column:
    """J8: '1023 B', '1.5 KiB', ... one decimal, ties to even."""
    n = _c(n).cast("long")
    expr = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, u in enumerate(BYTE_UNITS):
        div = 1024 ** (i + 1)
        txt = F.format_string("%.1f %siB", F.bround(n / F.lit(float(div)), 1), F.lit(u))
        expr = expr.when(n < div * 1024, txt) if i < len(BYTE_UNITS) - 1 else expr.otherwise(txt)
    return expr


def short_version(s) -> Column:
    """Version text cut before ' on ' (not when it starts the text)."""
    s = _c(s)
    return F.when(F.locate(" on ", s) > 1, F.substring_index(s, " on ", 1)).otherwise(s)


# Fixed patterns of the index-definition parser (P6), ASCII word boundaries.
_B = r"(?<![A-Za-z0-9_])"
_E = r"(?![A-Za-z0-9_])"
_S = r"[\t\n\f\r ]*"
IDX_M = rf"(?i){_B}m{_S}={_S}'?([0-9]+)'?"
IDX_EFC = rf"(?i)ef_construction{_S}={_S}'?([0-9]+)'?"
IDX_LISTS = rf"(?i){_B}lists{_S}={_S}'?([0-9]+)'?"
IDX_OPCLASS = (rf"(?i){_B}(vector_(?:cosine|l2|ip)_ops|halfvec_[A-Za-z0-9_]+_ops|"
               rf"bit_[A-Za-z0-9_]+_ops|sparsevec_[A-Za-z0-9_]+_ops){_E}")


def _int_or_zero(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")).try_cast("int"), F.lit(0))


def parse_index_def(ddl) -> dict[str, Column]:
    """M, ef_construction, lists, opclass out of index DDL text;
    absent -> 0 / ''."""
    d = _c(ddl)
    return {"m": _int_or_zero(F.regexp_extract(d, IDX_M, 1)),
            "ef_construction": _int_or_zero(F.regexp_extract(d, IDX_EFC, 1)),
            "lists": _int_or_zero(F.regexp_extract(d, IDX_LISTS, 1)),
            "opclass": F.regexp_extract(d, IDX_OPCLASS, 1)}
