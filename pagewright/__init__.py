"""Page search and analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors with the jobs that use them, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
