"""tidefeed: a Spark-native news analytics, de-duplication and recommendation engine."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors don't need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
