"""Validation and analytics operators for hierarchical codes, as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel inside the task closure, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
