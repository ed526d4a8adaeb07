"""Interval, feature and statistics operators over binned multi-track data, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
