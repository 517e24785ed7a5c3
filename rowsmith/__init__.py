"""rowsmith: turn messy sources into typed tables and query them, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for the executors travel with the plan, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
