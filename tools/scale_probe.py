"""Throughput of the core plan on a larger synthetic table.

    python tools/scale_probe.py ROWS DIM [QUERIES]

Writes ROWS synthetic unit vectors to the shared folder, then times exact
top-10 (block kernel) for QUERIES sampled queries and the full recall
evaluation (truth, sample-trained IVF, sweep).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nnprobe.operators import knn, sampling  # noqa: E402
from nnprobe.plans.evaluation import EvalConfig, evaluate  # noqa: E402
from nnprobe.session import local_session, scratch_path  # noqa: E402
from nnprobe.sources.synthetic import read_dataset, unit_vectors, write_dataset  # noqa: E402


def main():
    rows, dim = int(sys.argv[1]), int(sys.argv[2])
    nq = int(sys.argv[3]) if len(sys.argv) > 3 else 200
    spark = local_session(8)
    out = {"rows": rows, "dim": dim, "queries": nq}
    t = time.perf_counter()
    path = write_dataset(unit_vectors(spark, rows, dim, seed=7), scratch_path(spark, "synth"), partitions=32)
    out["generate_write_s"] = round(time.perf_counter() - t, 2)
    base = read_dataset(spark, path)
    t = time.perf_counter()
    q = sampling.sample_queries(base, nq)
    out["sample_s"] = round(time.perf_counter() - t, 2)
    t = time.perf_counter()
    knn.exact_knn(base, q, 10, "cosine").write.format("noop").mode("overwrite").save()
    s = time.perf_counter() - t
    out["exact_knn_s"] = round(s, 2)
    out["distances_per_s"] = round(rows * nq / s)
    t = time.perf_counter()
    lists = 256
    evaluate(base, EvalConfig(metric="cosine", k=10, queries=nq, lists=lists,
                              efforts=(1, 4, 16, 64, 256))).points.write.format("noop").mode("overwrite").save()
    out["recall_eval_s"] = round(time.perf_counter() - t, 2)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
