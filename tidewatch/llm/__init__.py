"""Operators for large text corpora, and their registered queries.

Nothing outside this package imports it. Every operator is a function from
DataFrames to a DataFrame; Python runs only inside tasks, on Arrow batches.
Its functions travel to the executors by value, so they need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
