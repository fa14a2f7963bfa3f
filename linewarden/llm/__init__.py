"""Operators for training-data pipelines; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# tasks get this folder's functions by value, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
