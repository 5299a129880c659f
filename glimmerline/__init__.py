"""Signal intelligence over landed text, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
