"""brackish: water-quality and plankton survey analytics as Spark DataFrame plans.

Layout
------
functions/   column expressions: strict aggregates, calendar, text, numeric, geometry
operators/   DataFrame -> DataFrame building blocks and the domain operators
sources/     schemas, readers and writers
plans/       the registered queries, the adapter views they read, their SQL twins
"""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
