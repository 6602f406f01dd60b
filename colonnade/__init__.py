"""Colonnade: relational profiling, schema analysis and SQL-text analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
