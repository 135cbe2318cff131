"""alertmill: security-findings analytics as plain ``DataFrame -> DataFrame`` functions."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
