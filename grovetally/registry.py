"""Every query of the engine and its SQL, by name."""

from .plans import volumes  # noqa: F401  registers its queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
