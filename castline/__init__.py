"""Profile-observation analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job: they need not find it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
