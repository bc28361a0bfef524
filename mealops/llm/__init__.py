"""Training-data operators: dedup, packing, filters, scans, sharding, archives.

Functions that run in Python workers travel with their code (pickled by
value), so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
