"""The registered query catalog: name -> (spark_fn(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from nnprobe.plans import catalog_checks, catalog_measure, catalog_stream, catalog_text, catalog_vectors

MODULES = [catalog_vectors, catalog_measure, catalog_text, catalog_stream, catalog_checks]


def entries() -> dict:
    out = {}
    for m in MODULES:
        for name, pair in m.entries().items():
            if name in out:
                raise ValueError(f"duplicate query name {name}")
            out[name] = pair
    return out
