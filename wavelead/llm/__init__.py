"""Operators for large collections of training text: one module per operator.

Functions that run in Python workers travel with the query, so executors need
Spark and the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
