"""Spark-native evidence analytics.

Python workers need no copy of this package: its functions travel with the tasks that use them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
