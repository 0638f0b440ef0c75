"""Article digests on Spark: DataFrame operators from feed scan to rendered issue."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job; executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
