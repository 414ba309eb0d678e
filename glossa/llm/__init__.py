"""Operators for large training-data pipelines: thirteen operators and the queries
that apply them. Nothing else in the library imports this subpackage.

Functions of this subpackage that run inside tasks are serialised by value, so
Python workers need only the third-party packages, not this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
