"""plumbline: messy business data to trusted analysis, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so the package need not be installed on workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
