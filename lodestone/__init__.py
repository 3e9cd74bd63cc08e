"""Lodestone: PySpark operators for document corpora, property graphs and retrieval.

Functions that run inside tasks are pickled by value, so executors need no copy
of this package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
