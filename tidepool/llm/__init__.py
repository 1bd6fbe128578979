"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so a cluster needs no
# copy of the package on its workers' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
