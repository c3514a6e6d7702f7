"""Operators of a training-data pipeline (language, quality, licences,
duplicates, decontamination, packing, search, toxicity, sharding)."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the Python workers by value, so that the
# executors need no installed copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
