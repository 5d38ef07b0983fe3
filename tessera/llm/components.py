"""Connected components of links between documents; the library's own rounds over an edge table."""

from __future__ import annotations

from ..operators.components import connected_components

__all__ = ["connected_components"]
