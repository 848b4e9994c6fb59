"""Operators for preparing training text.  Nothing outside this package imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
