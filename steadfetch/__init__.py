"""steadfetch: robust retrieval data jobs on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a session works
# whether or not the package is installed on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
