"""bidweave: PySpark table and stream operators for procurement-notice analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python steps travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
