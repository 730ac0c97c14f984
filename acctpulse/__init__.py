"""Account-health analytics as Spark DataFrame operators.

Functions of this package that run inside tasks are sent to the executors by
value, so that the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
