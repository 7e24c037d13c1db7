"""tessera: graph-community analytics as Spark DataFrame operators.

Functions that reach the executors are pickled by value, so that a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
