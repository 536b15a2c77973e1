"""Linked-data analytics on PySpark: every operator is a DataFrame-to-DataFrame function."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: these need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
