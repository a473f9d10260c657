"""Operators of a training-data pipeline over documents, pages, benchmark and labels.

Functions of this package run inside Python workers; they are pickled by value,
so executors need numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
