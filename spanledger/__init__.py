"""Spark-native data work for inspection intake and drawing review."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
