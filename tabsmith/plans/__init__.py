"""Step lists and the operator registry."""
