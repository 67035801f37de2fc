"""General operators on DataFrames."""

from quarry.operators.ranking import latest, top_per_group

__all__ = ["latest", "top_per_group"]
