"""Spark-native preparation, generation and evaluation of news-style text."""

import sys

from pyspark import cloudpickle

# Ship this package's functions to the executors by value, so that workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
