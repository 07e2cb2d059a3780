"""PySpark-native analytics for public tenders and contract awards.

Python functions of this package are shipped to executors by value, so a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
