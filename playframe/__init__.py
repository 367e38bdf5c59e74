"""Analytics on frame-level tracking data and general event tables, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
