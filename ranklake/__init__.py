"""Ranklake: hybrid retrieval, ranking, evaluation and record cleaning as Spark DataFrame operators.

Every operator takes DataFrames and plain parameters and returns a DataFrame; a reference date is always a parameter,
never the wall clock. Operators first select the columns they need under names of their own, so extra columns of the
input never clash with what an operator computes.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what Python workers call is sent with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
