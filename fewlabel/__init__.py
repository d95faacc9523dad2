"""Retrieval and evaluation of labelled text on Spark, for tasks where labels are scarce."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
