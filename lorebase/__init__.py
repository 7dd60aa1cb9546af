"""Lorebase: shared-knowledge-store analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers receive our few vectorised helpers inside the task closure,
# so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
