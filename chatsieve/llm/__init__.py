"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
