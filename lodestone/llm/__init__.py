"""Operators for preparing large text corpora; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions for the executors are sent whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
