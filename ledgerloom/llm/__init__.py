"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage. Its functions travel to executors by value, so that nothing has
to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
