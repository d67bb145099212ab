"""Process-log analytics on Spark: interval event logs, state distances, mismatch sweeps, snapshots and rankings."""

import sys

from pyspark import cloudpickle

# Functions for Spark's Python workers travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
