"""Analytics for the data around language-model post-training, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this package travel to Python workers with their code, so executors
# need no copy of it
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
