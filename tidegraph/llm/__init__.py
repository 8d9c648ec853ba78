"""Operators for training data: documents, their duplicates, mixtures, tokens and dialogues.

Nothing else in the library imports this package. Functions that run on executors
travel by value, so executors need the Python libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
