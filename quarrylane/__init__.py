"""Market analytics on PySpark: sources, functions, operators, query plans, streaming."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
