"""Analytics SQL over files, answered by Spark."""

from .errors import LoomError
from .session import Engine

__all__ = ["Engine", "LoomError"]
