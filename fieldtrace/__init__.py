"""Sports-tracking queries and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel to the executors with the plan, so that a cluster
# does not need this package on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
