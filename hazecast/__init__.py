"""Hourly air-quality features, exploration and forecasting on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the job: they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
