"""tessera: document and code retrieval analytics as Spark plans.

The package is pickled by value into Python workers, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
