"""Taxonomy graph maintenance and text-to-concept mapping as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Ship the package's Python functions with the tasks: executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
