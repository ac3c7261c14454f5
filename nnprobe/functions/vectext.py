"""Vector text columns (S2, S3): ``"[1,2,3]"`` <-> ARRAY<FLOAT>.

Parsing is a column job: rows that are not a bracketed, comma-separated list
of numbers get a NULL vector and ``vec_error = true`` instead of failing the
job.  ``"[]"`` is the empty vector.  The round-trip contract is
parse(render(v)) == v (Java prints ``1.0`` where other engines print ``1``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed number syntax: decimal, or the words for infinity and not-a-number.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
WORD = r"(?i)^(?:[+-]?(?:inf|infinity)|nan)$"


def _number(p: Column) -> Column:
    """FLOAT of a trimmed part; NULL if it is no number or out of range."""
    x = p.try_cast("float")
    return F.when(p.rlike(NUMBER) & (F.abs(x) < F.lit(float("inf"))), x).when(p.rlike(WORD), x)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render(v) -> Column:
    """S3: shortest float text joined by commas in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ","),
                    F.lit("]"))


def parse(s) -> tuple[Column, Column]:
    """(vector, error) columns for a text column.

    Outer blanks are trimmed, then the text must start with '[' and end with
    ']'; the inside is split on ',' and every trimmed part must be a number
    within the range of FLOAT.
    An empty inside is the empty vector; a NULL input is a NULL vector and
    not an error.
    """
    t = F.regexp_replace(_c(s), r"^\s+|\s+$", "")
    shaped = t.rlike(r"^\[[\s\S]*\]$")
    inner = t.substr(F.lit(2), F.length(t) - 2)
    parts = F.transform(F.split(inner, ","),
                        lambda p: _number(F.regexp_replace(p, r"^\s+|\s+$", "")))
    bad_part = F.exists(parts, lambda x: x.isNull())
    error = F.when(t.isNull(), F.lit(False)).when(~shaped, F.lit(True)) \
        .when(inner == "", F.lit(False)).otherwise(bad_part)
    vec = (F.when(t.isNull() | error, F.lit(None).cast("array<float>"))
           .when(inner == "", F.array().cast("array<float>"))
           .otherwise(parts))
    return vec, error
