"""Training-data operators: dedup, search, tagging, mixing, tokenising, output.

Nothing outside this subpackage imports it.  Its functions travel to the
Python workers by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
