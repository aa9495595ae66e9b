"""Operators for training-data pipelines. Nothing else in the library imports this package.

The functions of this package that run inside Spark tasks travel with the tasks, so executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
