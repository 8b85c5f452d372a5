"""An analytics engine on Spark for captured traffic, its index and the time-series regions beside it."""

import sys

from pyspark import cloudpickle

# Functions go to the workers with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
