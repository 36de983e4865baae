"""Vector-tile and style queries on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
