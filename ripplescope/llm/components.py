"""Connected components, which the graph operators use too."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
