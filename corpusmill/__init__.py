"""Spark-native engine for document retrieval, chunking, ranking, fusion and evaluation.

Functions of this package that run on executors travel by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
