"""Corpus retrieval, scoring, evaluation and conversation tables as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the batch functions by value, so the package need not be installed on
# the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
