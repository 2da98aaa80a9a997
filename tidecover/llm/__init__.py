"""Operators for building large text training corpora.

Every operator is a function ``DataFrame -> DataFrame``.  Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions for tasks are sent whole, so that workers needn't have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
