"""Repair and triage of damaged JPEG collections, as Spark DataFrames.

Files, marker segments, MCU grids, coefficient blocks, pixels and repair steps
are tables; each operator takes DataFrames and returns a DataFrame, lazy
unless it has to iterate.
"""

import sys

from pyspark import cloudpickle

# The two kernels travel with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
