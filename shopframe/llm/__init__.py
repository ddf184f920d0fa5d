"""Training-data operators: near-duplicate removal, toxicity, substring and
line deduplication, source mixing, sharding, decontamination, quality rules
and language identification. Nothing else in the library imports this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions are pickled by value: executors need numpy and pyarrow, but
# not this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
