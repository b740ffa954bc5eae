"""Retail sales analytics as parameterised Spark operators (DataFrame in, DataFrame out)."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with them, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
