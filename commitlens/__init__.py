"""commitlens: version-control-history analytics as lazy PySpark DataFrame queries.

The package's functions are pickled by value, so executors need only the
third-party libraries, not this code, on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
