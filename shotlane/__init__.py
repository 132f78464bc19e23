"""Shot and trajectory analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from shotlane.config import DEFAULT, Settings

# Functions of this package travel to the workers by value: a cluster needs no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT", "Settings"]
