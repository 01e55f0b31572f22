"""photolake: a Spark-native analytics engine for photo libraries."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so a cluster needs no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
