"""sondewerk: condition monitoring and series analytics on Spark DataFrames.

Functions are shipped to Python workers by value, so executors need not have
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
