"""lodetrace: event-log mining on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Workers get this package's functions and classes by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(__import__(__name__))
