"""Training-data operators: ten operators over `documents`-shaped tables and their named queries.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
