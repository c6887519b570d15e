"""URL-risk analytics as Spark DataFrame jobs.

Sub-packages: ``sources`` (readers, catalogs, stores), ``functions`` (column expressions),
``operators`` (DataFrame-to-DataFrame steps), ``plans`` (whole jobs and the query registry) and
``streaming`` (the same steps on streams).
"""

import sys

from pyspark import cloudpickle

# ship the functions of this package with the job, so executors do not need it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
