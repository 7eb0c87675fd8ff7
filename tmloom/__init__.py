"""Batch translation work on Spark: memory, hints, requests, results, reports."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks are shipped with the task, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
