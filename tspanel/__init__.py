"""Panels of calendar time series on Spark: prepare, describe, model, forecast."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the small array helpers inside the tasks, so that executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
