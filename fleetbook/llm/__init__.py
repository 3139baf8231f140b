"""Training-data operators: thirteen numbered operators over documents, embeddings,
pages and conversations, and the queries that apply them.

Nothing else in the library imports this subpackage. Python functions that run
in tasks are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
