"""Log operations as Spark DataFrame operators: ingest, filter, aggregate, detect, retain, verify."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
