"""vitalscope: Spark DataFrame operators for tables that mix short free text,
measurements and an ordered class label."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry this package's code with them, so nothing
# has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
