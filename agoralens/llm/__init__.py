"""Operators for training data of language models.

Nothing else in the library imports this subpackage.  Its functions travel to the
executors by value, so these need numpy, pyarrow and the tokenizers library, but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
