"""Corpus preparation, retrieval and retrieval evaluation as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the task, so a cluster needs
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
