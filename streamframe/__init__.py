"""A PySpark-native stream and batch engine: fluent pipelines over DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

#: Functions of this package travel to the executors by value: they need no copy of it there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
