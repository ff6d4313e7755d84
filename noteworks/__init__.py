"""noteworks: DataFrame operators for client-intelligence work on free-text notes."""

import sys

from pyspark import cloudpickle

# Python workers get the small task functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
