"""Labelled-interval, signal-window and stream-detection operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
