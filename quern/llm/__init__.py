"""Operators for preparing language-model training data.

The subpackage is self-contained: nothing else in the library imports it, and
its queries are listed in :mod:`quern.llm.queries`. Its functions travel to the
executors by value, so that a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
