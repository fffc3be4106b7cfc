"""Geospatial energy-siting analytics as DataFrame and SQL expressions."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
