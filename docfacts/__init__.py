"""docfacts: a PySpark-native document-analytics engine.

Python helpers used inside tasks are shipped to the executors by value, so the
package need not be installed on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
