"""Operators for preparing training text: scoring, filters, deduplication, mixing, sharding.

Functions that run in tasks are sent to the executors by value, so that the package has to
be installed only where the driver runs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
