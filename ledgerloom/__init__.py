"""Commerce analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
