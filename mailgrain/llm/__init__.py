"""Operators for training-data corpora; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# The functions that tasks run are shipped by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
