"""Where graphs come from: tables, files, operations."""

import sys

from pyspark import cloudpickle

# Executors get the reader's functions with the task, whether or not they have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
