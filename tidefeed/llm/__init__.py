"""Operators for preparing language-model training data.

Nothing outside this package (and corpus_pipeline.py) imports it. Functions that run in Python workers are shipped by
value, so executors don't need this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
