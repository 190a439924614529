"""vigilflow: network-security analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helper functions travel to the Python workers by value, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
