"""All registered queries of the security operators, with the SQL that gives the same rows."""

from .plans import flows as _flows
from .plans import models as _models
from .plans import sequences as _sequences
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "_flows", "_models", "_sequences"]
