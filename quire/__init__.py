"""Quire: document-corpus analytics as composable PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
