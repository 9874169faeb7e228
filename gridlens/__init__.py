"""gridlens: Spark-native analytics for network telemetry, event records and rule pipelines."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so they need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
