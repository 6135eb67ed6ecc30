"""Longitudinal health-record and genome-wide association analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from cohortspark.session import scratch_dir, tune

# Functions that run in Python workers travel with the job; executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["scratch_dir", "tune"]
