"""Parcel indicators and their supporting data work as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the job, so that executors
# need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
