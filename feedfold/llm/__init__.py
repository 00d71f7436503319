"""Operators for training corpora. Their task code travels with the job, so executors need not have this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
