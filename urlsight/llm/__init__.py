"""Operators for preparing training data: de-duplication, filters, scans, mixing, packing, shards."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from urlsight import session

# Functions of these modules run in Python workers. Pickled by value they need no copy of the
# package on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
# A module that is passed on whole takes its helpers along, and they know the session's.
cloudpickle.register_pickle_by_value(session)
