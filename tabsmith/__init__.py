"""Tabular statistics, data preparation and process diagnosis on PySpark."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
