"""lodestone: career, citation and flow analytics as DataFrame -> DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the functions that they run with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
