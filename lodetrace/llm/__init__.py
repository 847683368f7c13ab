"""Training-data operators. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle as _cloudpickle

import lodetrace as _package

# Workers get these functions by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_package)
