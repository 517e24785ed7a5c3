"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel with the plan, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
