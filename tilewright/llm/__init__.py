"""Training-data operators: scoring, language, near-duplicates, secrets, quality, mixing, URLs, packing, neighbours.

Nothing else in the library imports this subpackage. Functions that run in tasks travel by value,
so Python workers need not have this folder on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
