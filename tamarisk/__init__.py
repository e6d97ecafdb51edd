"""tamarisk: grounded retrieval, answer auditing and evaluation as Spark plans."""

__version__ = "0.2.0"

import sys

from pyspark import cloudpickle

# executors need no copy of the package: functions sent to Python workers carry their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.backends import Backend, ChatOptions, HashingBackend, UdfBackend, create_backend
from .plans.pipeline import RagPipeline, ingest
from .plans.settings import Settings
from .sources.store import EmptyIndex, IndexMismatch, IndexUnusable, Store

__all__ = [
    "Backend", "ChatOptions", "EmptyIndex", "HashingBackend", "IndexMismatch", "IndexUnusable", "RagPipeline", "Settings", "Store", "UdfBackend",
    "create_backend", "ingest",
]
