"""Imports every query module so that the registry is complete."""
from . import view_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from . import metric_queries  # noqa: F401
from . import link_queries  # noqa: F401
from . import signal_queries  # noqa: F401
from . import model_queries, stream_queries  # noqa: F401
