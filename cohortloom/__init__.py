"""Cohort phenotyping on Spark: DataFrame-in, DataFrame-out operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
