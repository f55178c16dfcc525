"""Analytics over labelled volumes, measurement tables and text corpora on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
