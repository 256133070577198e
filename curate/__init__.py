"""Model-based selection of multilingual text, as DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their closures, so executors need no installed copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
