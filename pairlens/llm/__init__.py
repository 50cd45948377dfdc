"""Operators for preparing training data: deduplication, mixing, filtering, scoring and token files.

Functions of this package go to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
