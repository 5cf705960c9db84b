"""Operators over code graphs and their tables."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this folder with the task, whether or not they have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
