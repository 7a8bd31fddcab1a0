"""A Spark-native engine for retrieval-augmented question answering and knowledge graphs."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value, so a job needs nothing installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
