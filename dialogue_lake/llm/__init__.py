"""Operators of a training-data pipeline over tables of documents.

Every operator takes a DataFrame and the names of its columns and ignores all others. The
Arrow functions travel to executors by value: workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
