"""Operators of a training-data pipeline; nothing outside this package imports it.

Functions of this package that run in Python workers are sent with the job, so the
executors need the public libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
