"""Operators of a training-data pipeline and their registered queries.

Functions of this package are pickled by value, so executors need no copy of
the repository: a task carries the code it runs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
