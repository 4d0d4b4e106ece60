"""axonframe: spiking-network analytics as Spark DataFrame, SQL and streaming plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
