"""Escalation analytics over very large tables of debate messages, on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the task, so a cluster needs no
# copy of the package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
