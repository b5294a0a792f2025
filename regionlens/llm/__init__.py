"""Operators for preparing training text; nothing else in the package imports this one.

Functions that run inside Python workers are shipped by value, so executors need
numpy, pyarrow and the tokenizer libraries, but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
