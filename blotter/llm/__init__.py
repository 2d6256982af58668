"""Training-data operators.  Nothing else in the library imports this package.

The functions that run inside Python workers are shipped with each task
(pickled by value), so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
