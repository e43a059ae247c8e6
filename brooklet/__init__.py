"""Record-stream operators for Spark: the same functions on batch and streaming DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the small Arrow and pandas helpers with the task, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
