"""paxcast: passenger-volume forecasting and event-contract analytics on Spark.

Every public operator takes and returns DataFrames keyed by series, airport,
route, contract, event or account. Work is expressed with built-in DataFrame
and SQL expressions so Catalyst can push filters and prune columns; Python
runs only inside Arrow-batched grouped functions where a recursion or keyed
state cannot be written as an expression.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel by value: executors need no
# copy of the package, whatever folder the driver runs in.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
