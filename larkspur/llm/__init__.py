"""Operators for building text-training corpora.

Nothing else in the library imports this subpackage.  ``queries`` registers
the operators with the driver; each operator has a module of its own.

Functions that run in Python workers travel by value, so executors need not
have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
