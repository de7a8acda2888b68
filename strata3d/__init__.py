"""strata3d: three-dimensional land records as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so a cluster needs no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
