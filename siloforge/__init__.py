"""A Spark-first engine for federated multi-label feature selection."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors may not have this package on their path; ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
