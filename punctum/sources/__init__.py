"""Reading the engine's tables."""

from punctum.sources.tables import table

__all__ = ["table"]
