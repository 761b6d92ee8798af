"""Operators of a training-data pipeline (LM scoring, packing, deduplication, ...).

Nothing else in the library imports this package.  Task functions travel to the
executors by value, so a worker needs numpy and Arrow but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
