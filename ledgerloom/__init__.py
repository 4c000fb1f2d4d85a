"""Entity analytics over blockchain balance movements, on Spark DataFrames.

Python functions of the package travel to executors by value, so that nothing has to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
