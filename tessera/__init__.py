"""tessera: alignment, timing and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions that run on executors travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
