"""Operators for preparing training data, and their queries."""

from pyspark import cloudpickle

import requestloom

# Tasks get the package's functions by value, so nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(requestloom)
