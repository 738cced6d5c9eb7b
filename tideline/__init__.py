"""tideline: customer-retention analytics written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry this package's functions and classes with them, so the
# executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
