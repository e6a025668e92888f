"""Message integration on Spark: envelopes in, converted, filtered, routed, tracked and delivered."""

import sys

from pyspark import cloudpickle

from .session import build_session  # noqa: F401

__version__ = "0.1.0"

# Code of this package goes to Python workers by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
