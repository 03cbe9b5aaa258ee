"""Operators of a training-data pipeline, their queries and check SQL.

The package is pickled by value, so that executors do not need it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
