"""chronoplace: place-centred search and analytics over encyclopedic corpora, as Spark plans.

Functions that run on executors are pickled by value, so executors need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
