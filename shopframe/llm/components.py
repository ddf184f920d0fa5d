"""Connected components, as the storefront has them."""

from ..operators.components import FEW_EDGES, components  # noqa: F401
