"""Point-in-time analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
