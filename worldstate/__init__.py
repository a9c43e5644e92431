"""Spark-native operators for world-state and telemetry data.

Every public operator is a plain function over DataFrames or Columns; see the README
for the list and ``worldstate.plans`` for runnable queries over the test tables.
"""

import sys

from pyspark import cloudpickle

# Step functions travel to the executors with the plan; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
