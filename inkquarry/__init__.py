"""PySpark-native engine for document collections: text search, form data, page sets, rules, and training-data operators."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
