"""Log analytics on Spark: read, search, number, count and follow logs of any size."""

import sys

from pyspark import cloudpickle

# Functions used inside of tasks travel with the job, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
