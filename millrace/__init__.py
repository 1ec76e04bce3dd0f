"""Feature preparation, clustering and run-log analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
