"""Corpus ingestion, retrieval and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so that the workers need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
