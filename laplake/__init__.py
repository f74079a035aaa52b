"""Laplake: race-lap analytics as Spark DataFrame operators.

Every operator maps DataFrames to DataFrames over all races at once. Group keys
and the order column are parameters, so the same code serves any table of
entities with ordered measurements.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent by value, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
