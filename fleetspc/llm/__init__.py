"""Operators for preparing training data. Nothing else in the package imports this one.

Functions that run in Python tasks travel with the job, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
