"""Operators for preparing training data: sharding, filtering, de-duplication, scoring, mixing and formatting."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run there travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
