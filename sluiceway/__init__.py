"""Stream and table operators written as plain ``DataFrame -> DataFrame`` functions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the workers need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
