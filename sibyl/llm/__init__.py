"""Operators for preparing language-model training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so a worker need not have the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
