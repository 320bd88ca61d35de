"""Route-art analytics on Spark: catalogue, label geocoding, reconstruction and route choice as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with their code, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
