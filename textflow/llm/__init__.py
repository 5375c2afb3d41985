"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``registry`` binds the operators to the
shared tables as the ``opN_`` queries.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the job, which
# need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
