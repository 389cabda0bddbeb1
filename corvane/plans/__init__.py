"""Query parsing and the plans that parsed queries become."""
