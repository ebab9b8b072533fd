"""mendframe: repair and cleaning of delimited data as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
