"""Folia: document-layout analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the executors by value: workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
