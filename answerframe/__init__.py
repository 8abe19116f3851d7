"""Survey-text features and model selection as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
