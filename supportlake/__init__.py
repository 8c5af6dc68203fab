"""Support-knowledge analytics on Spark: DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
