"""Feature, split, probe and audit operators over labelled, grouped entities.

Every operator takes and returns DataFrames. See README.md for the module map.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
