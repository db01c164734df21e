"""Cache-workload analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Python workers then need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
