"""Training-data operators: thirteen corpus-scale transforms, independent of the rest of the library."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so that a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
