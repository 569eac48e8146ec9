"""Corpus analytics as Spark DataFrames.

Every operator is a function of DataFrames and parameters that returns a
DataFrame; nothing is executed until the caller asks for it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel with their code, so executors need neither
# this package installed nor the driver's working folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
