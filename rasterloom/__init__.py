"""Raster-tile analytics over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors unpickle our functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
