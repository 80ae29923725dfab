"""Connected components, as the other operators have them."""

from roadloom.operators.links import components  # noqa: F401
