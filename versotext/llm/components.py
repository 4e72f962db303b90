"""Connected components, as the library has them."""

from versotext.components import connected_components

__all__ = ["connected_components"]
