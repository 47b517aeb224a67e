"""Change-data-capture analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Python tasks carry this package's code with them: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
