"""Table readers."""

from quarry.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
