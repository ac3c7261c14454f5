"""nnprobe: vector-search evaluation as Spark DataFrame jobs.

Exact and inverted-file nearest-neighbour search, recall sweeps, latency and
throughput statistics over measurement tables (batch and Structured
Streaming), nearest-reference lookup and text scrubbing.
"""

import sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (the block
# kernels, the position numbering) are pickled by value, so executors need
# neither this package installed nor the driver's working directory.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile instead
    pass
