"""A Spark-native engine for threshold-bit, clause-voting classification of tables.

Models are tables, scoring is a join followed by an aggregate.  Functions that
run in Python workers are pickled by value, so a cluster needs no copy of this
package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
