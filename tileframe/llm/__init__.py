"""Operations of a large-scale training-data pipeline.

One module per operator; ``registry`` lists the queries and their SQL.
Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a cluster
# needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
